"""A small template language for conversations: source to syntax tree, to folded tree, to Python closures.

    {{ expression }}   {% set name = expression %}   {# comment #}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% for name in expression %} ... {% endfor %}
    {% generation %} ... {% endgeneration %}

A hyphen inside a tag (`{%-`, `-}}`) takes the white space on that side away. Expressions have strings, whole
numbers, true, false, none, lists, names, fields (`message.role`, `message['role']`), `+ ~ - == != < <= > >= in not
and or`, `a if c else b` and filters (`x | trim`). Text between generation tags is marked as generated.

Templates are sandboxed: a field is a key of a mapping and never a Python attribute, the only callables are the filters
that the compiler was given, and there is nothing that loops or grows without reading a list. `messages` is a stream: one
loop outside all others may go over it, so a conversation of any length is rendered holding one message.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

#: What a rendering yields after each message.
TURN = object()

TAG = re.compile(r"\{\{|\{%|\{#")
CLOSE = {"{{": "}}", "{%": "%}", "{#": "#}"}
TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<sign>[=!<>]=|[-+~<>()\[\].,|=]))""", re.S)
ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"true": True, "false": False, "none": None}
LOOP = ("index", "index0", "first", "last")


class TemplateError(ValueError):
    """The template is wrong; raised while it is compiled."""


def said(value: Any) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _field(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    return value[key] if isinstance(value, list) and isinstance(key, int) and -len(value) <= key < len(value) else None


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else said(a) + said(b)


def _within(a: Any, b: Any) -> bool:
    return said(a) in b if isinstance(b, str) else a in (b or ())


def _ordered(compare: Callable) -> Callable:
    return lambda a, b: type(a) is type(b) and a is not None and compare(a, b)


BINARY = {
    "+": _plus, "~": lambda a, b: said(a) + said(b), "-": lambda a, b: int(a or 0) - int(b or 0), "in": _within, "==": operator.eq, "!=": operator.ne,
    "<": _ordered(operator.lt), "<=": _ordered(operator.le), ">": _ordered(operator.gt), ">=": _ordered(operator.ge),
}
FILTERS: dict[str, Callable] = {"trim": lambda x: said(x).strip(), "upper": lambda x: said(x).upper(), "lower": lambda x: said(x).lower(), "length": lambda x: len(x or "")}


# -- source to pieces


def pieces(source: str) -> Iterator[tuple[str, str]]:
    """('text', text), ('{{', expression) and ('{%', statement) in order; comments and stripped white space are gone."""
    at, strip = 0, False
    while at <= len(source):
        tag = TAG.search(source, at)
        text = source[at : tag.start() if tag else len(source)]
        text = text.lstrip() if strip else text
        if tag is None:
            if text:
                yield "text", text
            return
        opened, inner = tag[0], tag.end()
        quoted = re.compile(r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|(?!%s).)*?%s""" % ((re.escape(CLOSE[opened]),) * 2), re.S) if opened != "{#" else re.compile(r".*?#\}", re.S)
        end = quoted.match(source, inner)
        if end is None:
            raise TemplateError(f"no {CLOSE[opened]} after {source[tag.start() : tag.start() + 20]!r}")
        body = end[0][:-2]
        text = text.rstrip() if body.startswith("-") else text
        if text:
            yield "text", text
        strip = body.endswith("-") and len(body) > 1
        if opened != "{#":
            yield opened, body.removeprefix("-").removesuffix("-").strip()
        at = end.end()


# -- pieces to a tree


class Parser:
    """Statements and expressions as tuples, the kind first. Names are checked against what is in scope."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.pieces, self.filters = list(pieces(source)), filters
        self.at, self.scope, self.loops, self.streams, self.generating = 0, ["messages"], 0, 0, False

    def tree(self) -> tuple:
        body, end = self.block(())
        if end:
            raise TemplateError(f"unexpected {end}")
        return body

    def block(self, ends: tuple[str, ...]) -> tuple[tuple, str]:
        """The statements before one of ends, and that one with what follows it."""
        found = []
        while self.at < len(self.pieces):
            kind, own = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                found.append(("text", own))
            elif kind == "{{":
                found.append(("emit", self.expression(own)))
            else:
                word, _, rest = own.partition(" ")
                if word in ends:
                    return tuple(found), own
                if word.startswith(("end", "el")) or not hasattr(self, f"read_{word}"):
                    raise TemplateError(f"unexpected {own!r}")
                found.append(getattr(self, f"read_{word}")(rest.strip()))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return tuple(found), ""

    def read_set(self, rest: str) -> tuple:
        name, _, value = rest.partition("=")
        name = name.strip()
        if not name.isidentifier() or name in ("messages", "loop", *WORDS):
            raise TemplateError(f"cannot set {name!r}")
        node = ("set", name, self.expression(value))
        self.scope.append(name)
        return node

    def read_if(self, rest: str) -> tuple:
        branches, other = [], ()
        test = self.expression(rest)
        while True:
            body, end = self.block(("elif", "else", "endif"))
            branches.append((test, body))
            if not end.startswith("elif"):
                break
            test = self.expression(end[4:])
        if end == "else":
            other, end = self.block(("endif",))
        return ("if", tuple(branches), other)

    def read_for(self, rest: str) -> tuple:
        match = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
        if match is None or match[1] in ("messages", "loop", *WORDS):
            raise TemplateError(f"for {rest!r}")
        stream = match[2].strip() == "messages"
        if stream:
            self.streams += 1
            if self.loops or self.streams > 1:
                raise TemplateError("messages is a stream: one outermost loop may go over it")
        items = ("name", "messages") if stream else self.expression(match[2])
        outer, self.scope = self.scope, [*self.scope, match[1], "loop"]
        self.loops += 1
        body, _ = self.block(("endfor",))
        self.loops, self.scope = self.loops - 1, outer
        return ("for", match[1], items, body, stream)

    def read_generation(self, rest: str) -> tuple:
        if rest or self.generating:
            raise TemplateError("generation within generation" if self.generating else f"generation {rest!r}")
        self.generating = True
        body, _ = self.block(("endgeneration",))
        self.generating = False
        return ("generation", body)

    def expression(self, source: str) -> tuple:
        tokens, at = [], 0
        while source[at:].strip():
            match = TOKEN.match(source, at)
            if match is None:
                raise TemplateError(f"cannot read {source[at:]!r}")
            tokens.append((match.lastgroup, match[match.lastgroup]))
            at = match.end()
        self.tokens = [*tokens, ("end", "")]
        node = self.choice()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r} in {source!r}")
        return node

    def next(self, *wanted: str) -> str | None:
        """Takes the next token if it is one of wanted; strings are never words."""
        kind, own = self.tokens[0]
        if own in wanted and kind in ("name", "sign"):
            self.tokens.pop(0)
            return own
        return None

    def need(self, sign: str) -> None:
        if self.next(sign) is None:
            raise TemplateError(f"no {sign!r} before {self.tokens[0][1]!r}")

    def choice(self) -> tuple:
        node = self.either()
        if self.next("if"):
            test = self.either()
            node = ("choice", test, node, self.choice() if self.next("else") else ("const", None))
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.next("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.next("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.next("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while True:
            sign = self.next("==", "!=", "<", "<=", ">", ">=", "in", "not")
            if sign is None:
                return node
            if sign == "not":
                self.need("in")
                node = ("not", ("binary", "in", node, self.joined()))
            else:
                node = ("binary", sign, node, self.joined())

    def joined(self) -> tuple:
        node = self.filtered()
        while sign := self.next("+", "~", "-"):
            node = ("binary", sign, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while True:
            if self.next("."):
                kind, own = self.tokens.pop(0)
                if kind != "name":
                    raise TemplateError(f"a field cannot be {own!r}")
                node = ("field", node, ("const", own))
            elif self.next("["):
                node = ("field", node, self.choice())
                self.need("]")
            elif self.next("|"):
                own = self.tokens.pop(0)[1]
                if own not in self.filters:
                    raise TemplateError(f"no filter {own!r}")
                node = ("filter", own, node)
            else:
                return node

    def atom(self) -> tuple:
        kind, own = self.tokens.pop(0)
        if kind == "number":
            return ("const", int(own))
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPED.get(m[1], m[1]), own[1:-1], flags=re.S))
        if own == "(":
            node = self.choice()
            self.need(")")
            return node
        if own == "[":
            items = []
            while not self.next("]"):
                items.append(self.choice())
                if not self.next(","):
                    self.need("]")
                    break
            return ("list", tuple(items))
        if own == "-" and self.tokens[0][0] == "number":
            return ("const", -int(self.tokens.pop(0)[1]))
        if kind == "name" and own in WORDS:
            return ("const", WORDS[own])
        if kind == "name" and own == "messages":
            raise TemplateError("messages is a stream: a loop may go over it, nothing else")
        if kind == "name" and own in self.scope:
            return ("name", own)
        raise TemplateError(f"unknown {own!r}" if own else "an expression ends too soon")


# -- folding


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """An expression with everything worked out that depends on no name."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "list":
        items = tuple(fold(n, filters) for n in node[1])
        return ("const", [n[1] for n in items]) if all(n[0] == "const" for n in items) else ("list", items)
    if kind in ("and", "or", "choice"):
        first = fold(node[1], filters)
        if first[0] == "const":
            if kind == "choice":
                return fold(node[2] if first[1] else node[3], filters)
            return fold(node[2], filters) if bool(first[1]) == (kind == "and") else first
        return (kind, first, *(fold(n, filters) for n in node[2:]))
    parts = tuple(fold(n, filters) if isinstance(n, tuple) else n for n in node[1:])
    folded = (kind, *parts)
    if all(n[0] == "const" for n in parts if isinstance(n, tuple)):
        return ("const", evaluator(folded, filters)({}))
    return folded


def fold_block(body: tuple, filters: dict[str, Callable]) -> tuple:
    """Statements with constant output as text, branches that are never taken gone, and neighbouring texts as one."""
    found: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and found and found[-1][0] == "text":
            found[-1] = ("text", found[-1][1] + node[1])
        elif node != ("text", ""):
            found.append(node)

    for node in body:
        if node[0] == "emit":
            own = fold(node[1], filters)
            add(("text", said(own[1])) if own[0] == "const" else ("emit", own))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2], filters)))
        elif node[0] == "if":
            branches, other = [], fold_block(node[2], filters)
            for test, own in node[1]:
                test = fold(test, filters)
                if test[0] == "const":
                    if test[1]:
                        other = fold_block(own, filters)
                        break
                    continue
                branches.append((test, fold_block(own, filters)))
            if branches:
                add(("if", tuple(branches), other))
            else:
                for n in other:
                    add(n)
        elif node[0] == "for":
            items = fold(node[2], filters)
            if items != ("const", []):
                add(("for", node[1], items, fold_block(node[3], filters), node[4]))
        elif node[0] == "generation":
            add(("generation", fold_block(node[1], filters)))
        else:
            add(node)
    return tuple(found)


# -- closures


def evaluator(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "binary":
        apply, a, b = BINARY[node[1]], evaluator(node[2], filters), evaluator(node[3], filters)
        return lambda env: apply(a(env), b(env))
    if kind == "filter":
        apply, a = filters[node[1]], evaluator(node[2], filters)
        return lambda env: apply(a(env))
    if kind == "list":
        items = [evaluator(n, filters) for n in node[1]]
        return lambda env: [f(env) for f in items]
    parts = [evaluator(n, filters) for n in node[1:]]
    if kind == "field":
        a, key = parts
        return lambda env: _field(a(env), key(env))
    if kind == "not":
        (a,) = parts
        return lambda env: not a(env)
    if kind == "choice":
        test, yes, no = parts
        return lambda env: yes(env) if test(env) else no(env)
    a, b = parts
    return (lambda env: a(env) and b(env)) if kind == "and" else lambda env: a(env) or b(env)


Render = Callable[[dict, bool], Iterator]


def renderer(body: tuple, filters: dict[str, Callable]) -> Render:
    steps = [statement(n, filters) for n in body]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, generated: bool) -> Iterator:
        for step in steps:
            yield from step(env, generated)

    return run


def statement(node: tuple, filters: dict[str, Callable]) -> Render:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, generated: iter(((text, generated),))
    if kind == "emit":
        value = evaluator(node[1], filters)
        return lambda env, generated: iter(((said(value(env)), generated),))
    if kind == "generation":
        inner = renderer(node[1], filters)
        return lambda env, generated: inner(env, True)
    if kind == "set":
        name, value = node[1], evaluator(node[2], filters)

        def assign(env: dict, generated: bool) -> Iterator:
            env[name] = value(env)
            return iter(())

        return assign
    if kind == "if":
        branches = [(evaluator(t, filters), renderer(b, filters)) for t, b in node[1]]
        other = renderer(node[2], filters)

        def choose(env: dict, generated: bool) -> Iterator:
            for test, own in branches:
                if test(env):
                    return own(env, generated)
            return other(env, generated)

        return choose
    _, name, items, body, stream = node
    of, inner = evaluator(items, filters), renderer(body, filters)

    def each(env: dict, generated: bool) -> Iterator:
        rest = iter(of(env) or ())
        item, k = next(rest, TURN), 0
        while item is not TURN:
            after = next(rest, TURN)
            yield from inner({**env, name: item, "loop": dict(zip(LOOP, (k + 1, k, k == 0, after is TURN)))}, generated)
            if stream:
                yield TURN
            item, k = after, k + 1

    return each


def compiled(source: str, filters: dict[str, Callable] | None = None) -> Callable[[Iterable[dict]], Iterator]:
    """A function from messages to (text, generated) pieces, with TURN after what each message made."""
    known = FILTERS | (filters or {})
    run = renderer(fold_block(Parser(source, known).tree(), known), known)
    return lambda messages: run({"messages": messages}, False)
