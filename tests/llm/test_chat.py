import hashlib
import random

import pytest

from tessera.llm import chat
from tessera.llm import chat_template as ct

KIND = "conv_id long, turn long, role string, text string, part string, spans int, n_turns long"
NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KIND).repartition(3)


def plain(rows):
    """Everything but formatted_chars, from the rows themselves."""
    convs = {}
    for conv, turn, role, text in [*rows, (-7, 0, "user", chat.OWN), (-7, 1, "assistant", chat.OWN)]:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = []
    for conv, own in convs.items():
        own.sort()
        loss = b"".join(t for *_, r, t in own if r == b"assistant")
        turns = b"".join(r + b"\n" + t + b"\n" for *_, r, t in own)
        out.append((str(conv), len(own), hashlib.sha256(turns).hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest()))
    return sorted(out)


def odd_rows():
    rng = random.Random(3)
    bits = [*chat.CONTROLS, "\\", "<", "[", "<<s>", "\n", " ", "é", "\U0001f600", "ok", "]", ">", "/", "{{ x }}", "{% generation %}"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "<s>", "", None, "\\"]), rng.choice([None, "", *["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(6)]])) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again"), (5, None, "assistant", "no number"), (None, 1, "assistant", "no id"), (None, 0, "user", "</s>")]
    return rows + [(700, t, ("user", "assistant")[t % 2], f"turn {t} " * (t % 9)) for t in range(900)]  # a hot conversation


def test_turns_and_loss_come_back(spark, monkeypatch):
    for part in (1 << 20, 64):
        monkeypatch.setattr(chat, "PART", part)
        df = chat.op12(table(spark, odd_rows()))
        assert df.columns == NAMES
        assert sorted((str(r[0]), *r[1:5]) for r in df.collect()) == plain(odd_rows())
    assert [r["conv_id"] for r in chat.op12(table(spark, [])).collect()] == [-7]


def test_sql(spark, duck, tmp_path):
    table(spark, odd_rows()).write.parquet(f"{tmp_path}/c")
    duck.execute(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    want = duck.execute(chat.op12_sql()).fetchall()
    assert sorted(map(str, (tuple(r) for r in chat.op12(spark.read.parquet(f"{tmp_path}/c")).collect()))) == sorted(map(str, want))


def test_parts_hold_whole_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 64)
    parts = sorted((r["part"], r["text"], r["spans"], r["turns"]) for r in chat.formatted(table(spark, odd_rows())).where("conv_id = 700").collect())
    assert len(parts) > 20 and [p[0] for p in parts] == list(range(len(parts))) and sum(p[3] for p in parts) == 900
    escapes = chat.Escapes(chat.CONTROLS)
    for _, text, spans, turns in parts:
        own = list(chat.turns_of(text, escapes))
        assert len(own) == turns and [text[s["start"] : s["end"]] for s in spans] == [t for r, t in own if r == "assistant" and t]
    assert max(len(p[1]) for p in parts) < 64 + 200


def test_escapes():
    rng = random.Random(1)
    escapes = chat.Escapes(chat.CONTROLS)
    bits = ["<", ">", "/", "s", "[", "]", "\\", "INST", "SYS", "ROLE", *chat.CONTROLS]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(9)))
        assert escapes.unescape(escapes.escape(text)) == text
        for c in chat.CONTROLS:
            assert list(escapes.controls(c + escapes.escape(text) + c)) == [(c, escapes.escape(text)), (c, "")]
    for bad in (("ab", "bc"), ("ab", "abc"), ("aa",), ("a\\",)):
        with pytest.raises(ValueError):
            chat.Escapes(bad)
    for bad in ("x", "<s>a", "</s>a", "[INST]a[/INST]b", "<<ROLE>>a</s>b</s>", "[INST]a"):
        with pytest.raises(ValueError):
            list(chat.turns_of(bad, escapes))


def shown(source, messages=(), **filters):
    return "".join(p[0] for p in ct.compiled(source, filters)(iter(messages)) if p is not ct.TURN)


def test_template_language():
    messages = [{"role": "a", "content": " x "}, {"role": "b", "content": None, "n": 3}]
    assert shown("{% for m in messages %}{{ loop.index }}{{ m.role }}{{ m['content'] | trim }}{{ ',' if not loop.last }}{% endfor %}", messages) == "1ax,2b"
    assert shown("a {{- 1 + 2 -}} b {#- c -#} d{{ 'x' ~ 1 ~ true }}") == "a3bdx1true"
    assert shown("{% set k = 'q' %}{% for x in ['a', k] %}{{ x | upper }}{% set k = x %}{% endfor %}{{ k }}") == "AQq"  # a loop's names are its own
    assert shown("{% for m in messages %}{% if m.n >= 3 %}n{% elif m.content and 'x' in m.content %}x{% else %}-{% endif %}{% endfor %}", messages) == "xn"
    assert shown("{{ '%}' ~ \"}}\" ~ 'it\\'s\\n' }}") == "%}}}it's\n"
    assert shown("{{ 'b' not in 'abc' or none == 1 }}{{ 2 - 3 }}{{ -1 < 2 and 'y' }}") == "false-1y"
    assert shown("{% for m in messages %}{{ m.nothing.at.all }}{{ m.role.__class__ }}{% endfor %}", messages) == ""
    assert shown("{{ 'a' | twice }}", twice=lambda x: x * 2) == "aa"


def test_generation_marks():
    render = ct.compiled("{% for m in messages %}<{% generation %}{{ m.content }}{% if m.role == 'a' %}!{% endif %}{% endgeneration %}>{% endfor %}")
    assert list(render(iter([{"role": "a", "content": "x"}]))) == [("<", False), ("x", True), ("!", True), (">", False), ct.TURN]


def test_folding():
    def tree(source):
        return ct.fold_block(ct.Parser(source, ct.FILTERS).tree(), ct.FILTERS)

    assert tree("a{{ 'b' | upper ~ (1 + 1) }}{% if 1 == 2 %}no{% elif true %}c{% else %}no{% endif %}") == (("text", "aB2c"),)
    assert tree("{% for x in [] %}a{% endfor %}") == ()
    folded = tree("{% for m in messages %}{{ 'a' ~ 'b' ~ m.role }}{% if false or m.role %}{{ 1 }}{% endif %}{% endfor %}")
    assert folded == (("for", "m", ("name", "messages"), (("emit", ("binary", "~", ("const", "ab"), ("field", ("name", "m"), ("const", "role")))), ("if", ((("field", ("name", "m"), ("const", "role")), (("text", "1"),)),), ())), True),)


@pytest.mark.parametrize(
    "source",
    ["{{ x }}", "{{ 1", "{% if 1 %}", "{% endif %}", "{{ messages }}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% for a in [1] %}{% for m in messages %}{% endfor %}{% endfor %}",
     "{{ 'a' | open }}", "{{ 1 1 }}", "{% set messages = 1 %}", "{% import os %}", "{{ (1 }}", "{{ 'a'.1 }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ a() }}", "{{ }}", "{% block %}"],
)
def test_wrong_templates(source):
    with pytest.raises(ct.TemplateError):
        ct.compiled(source)
