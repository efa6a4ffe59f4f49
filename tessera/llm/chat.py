"""Conversations as training text, with what the model has to learn marked, and the way back.

A template (chat_template.py) says how turns are written. Strings that structure the text are control strings; where a
message holds one, or the mark itself, the mark is put before it, so control strings in the text are always the
template's. A conversation is rendered turn by turn as its sorted rows come in and is given in parts of whole turns, so
neither a long conversation nor one key with many rows is ever held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import chat_template

MARK = "\\"
#: A part is closed after the turn that brings it to so many characters; batches that leave a task are about as large.
PART = 1 << 20

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
TEMPLATE = """
{%- for message in messages -%}
  {%- set text = message.content | escape -%}
  {%- if message.role == 'user' -%} {{ '[INST]' ~ text ~ '[/INST]' }}
  {%- elif message.role == 'system' -%} {{ '<<SYS>>' ~ text ~ '<</SYS>>' }}
  {%- elif message.role == 'assistant' -%} {{ '<s>' }}{% generation %}{{ text }}{% endgeneration %}{{ '</s>' }}
  {%- else -%} {{ '<<ROLE>>' ~ (message.role | escape) ~ '<</ROLE>>' ~ text ~ '</s>' }}
  {%- endif -%}
{%- endfor -%}
"""
#: What each turn opens and closes with, by the control string that opens it.
TURNS = {"[INST]": ("user", "[/INST]"), "<<SYS>>": ("system", "<</SYS>>"), "<s>": ("assistant", "</s>")}


class Escapes:
    """Puts a mark before control strings and marks of a text, and takes it away again."""

    def __init__(self, controls: tuple[str, ...], mark: str = MARK):
        for d in controls:
            for c in controls:
                if any(c.startswith(d[k:]) or d[k:].startswith(c) for k in range(1, len(d))) or (c != d and c.startswith(d)) or mark in c:
                    raise ValueError(f"{d!r} and {c!r} cannot be told apart in a text")
        either = "|".join(re.escape(c) for c in controls)
        self._in = re.compile(f"{re.escape(mark)}|{either}")
        self._out = re.compile(f"{re.escape(mark)}(.)", re.S)
        self._find = re.compile(f"{re.escape(mark)}.|({either})", re.S)
        self.mark = mark

    def escape(self, text: object) -> str:
        return self._in.sub(lambda m: self.mark + m[0], chat_template.said(text))

    def unescape(self, text: str) -> str:
        return self._out.sub(r"\1", text)

    def controls(self, text: str) -> Iterator[tuple[str, str]]:
        """(control string, text up to the next one) in order. Raises ValueError if anything lies before the first."""
        opened, at = None, 0
        for m in self._find.finditer(text):
            if m[1]:
                if opened is not None:
                    yield opened, text[at : m.start()]
                elif m.start():
                    raise ValueError("text before the first control string")
                opened, at = m[1], m.end()
        if opened is not None:
            yield opened, text[at:]
        elif text:
            raise ValueError("text without control strings")


def parts_of(render, messages: Iterator[dict], most: int) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """(text, spans, turns): a conversation in parts of whole turns; spans are the generated stretches of a part's text."""
    said, spans, size, turns = [], [], 0, 0
    for piece in render(messages):
        if piece is chat_template.TURN:
            turns += 1
            if size >= most:
                yield "".join(said), spans, turns
                said, spans, size, turns = [], [], 0, 0
            continue
        text, generated = piece
        if generated and text:
            if spans and spans[-1][1] == size and said:
                spans[-1] = (spans[-1][0], size + len(text))
            else:
                spans.append((size, size + len(text)))
        said.append(text)
        size += len(text)
    if turns or said:
        yield "".join(said), spans, turns


def turns_of(text: str, escapes: Escapes) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that TEMPLATE made. Raises ValueError for a text that it cannot have made."""
    found = escapes.controls(text)
    for control, own in found:
        if control == "<<ROLE>>":
            role = escapes.unescape(own)
            control, own = next(found, ("", ""))
            ending = "</s>" if control == "<</ROLE>>" else None
        else:
            role, ending = TURNS.get(control, ("", None))
        closed, rest = next(found, ("", ""))
        if ending is None or closed != ending or rest:
            raise ValueError(f"{control!r} opens no turn, or it is not closed")
        yield role, escapes.unescape(own)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= PART:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def formatted(rows: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, text, spans, turns): each conversation as text, in parts of whole turns, almost always one.

    spans are (start, end) stretches of a part's text that the model has to learn. Turns come by number, those without
    one first, then by role and text. Null roles and texts are empty. Rows that repeat are turns each; rows without an
    id are one conversation. A part's task comes with its conversation's parts in order.
    """
    escapes = Escapes(controls)
    chat_template.compiled(template, {"escape": escapes.escape})  # a wrong template fails here, not in a task
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("turns", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = chat_template.compiled(template, {"escape": Escapes(controls).escape})

        def found() -> Iterator[tuple]:
            for conv, own in groupby(_stream(batches), key=lambda r: r[0]):
                messages = ({"role": r[2], "content": r[3]} for r in own)
                for k, (text, spans, turns) in enumerate(parts_of(render, messages, PART)):
                    yield conv, k, text, [{"start": a, "end": b} for a, b in spans], turns

        yield from _batches(found(), schema, lambda r: len(r[2]) + 100)

    plain = rows.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, part int, text string, spans array<struct<start: long, end: long>>, turns long")


def read_back(parts: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what formatted() gave, from its texts and spans alone.

    A conversation's digests grow part by part; parts must come as formatted() leaves them, in order and together.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escapes = Escapes(controls)

        def found() -> Iterator[tuple]:
            for conv, own in groupby(_stream(batches), key=lambda r: r[0]):
                turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, text, spans in own:
                    for role, said in turns_of(text, escapes):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for span in spans:
                        said = escapes.unescape(text[span["start"] : span["end"]])
                        loss.update(said.encode())
                        chars += len(said)
                    size += len(text)
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        yield from _batches(found(), schema, lambda r: 200)

    return parts.select("conv_id", "text", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OWN = "</s>[INST] ok [/INST]"


def op12(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows, and one for conversation -7.

    Null texts and roles are empty; turns that tie in number come by role, then by text, those without a number first;
    repeated rows are turns each; rows without an id are one conversation with a null id. Of an empty table comes
    conversation -7 alone. A conversation of any length is read and written turn by turn. Other columns, whatever their
    names, are not read.
    """
    kinds = "conv_id long, turn long, role string, text string"
    own = rows.sparkSession.createDataFrame([(-7, 0, "user", OWN), (-7, 1, "assistant", OWN)], kinds)
    given = rows.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in kinds.split(", ")))
    return read_back(formatted(given.unionByName(own)))


def op12_sql() -> str:
    signs = "|".join(re.sub(r"([\[\]])", r"\\\1", c) for c in CONTROLS)
    size = rf"length(regexp_replace({{}}, '(\\|{signs})', '\\\1', 'g'))"
    edges = {role: len(opened) + len(closed) for opened, (role, closed) in TURNS.items()}
    cases = " ".join(f"when '{role}' then {n}" for role, n in edges.items())
    other = len("<<ROLE>><</ROLE>></s>")
    order = "order by turn nulls first, role, text"
    return f"""
    with c as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '{OWN}' union all select -7, 1, 'assistant', '{OWN}')
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) as turns_sha256,
      cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
      sha256(coalesce(string_agg(text, '' {order}) filter (role = 'assistant'), '')) as loss_sha256,
      cast(sum({size.format("text")} + case role {cases} else {other} + {size.format("role")} end) as bigint) as formatted_chars
    from c group by conv_id"""
