"""Names of a table in texts against regular expressions."""

import random
import re

import regex

from tessera.operators import names

TITLE = r"(?:pastor|ps\.?|rev\.?|reverend|dr\.?|elder|bishop|brother|sister|father|fr\.?|deacon)"


def plain(text, known):
    text = text.replace("’", "'").replace("‘", "'")
    found = []
    for name in known:
        first, *others = name.split(" ")
        last = others[-1] if others else ""

        def word(pattern):
            return regex.search(rf"(?<!\p{{L}}){pattern}(?!\p{{L}})", text, regex.I)  # noqa: B023

        ways = [word(re.escape(name))]
        if len(last) >= 3 and last.lower() not in names.BOOK_NAMES:
            ways.append(word(re.escape(last)))
        if first:
            ways.append(word(rf"{TITLE}\s+{re.escape(first)}"))
            if first.lower() not in names.BOOK_NAMES:
                ways.append(word(rf"{re.escape(first)}'s"))
        if any(ways):
            found.append(name)
    return found


def cases(seed=3, n=1500):
    rng = random.Random(seed)
    known = ["Aaron Anderson", "Phil Friesen", "Mark Prater", "Grace Hopper", "Ann Li", "Ann Marie Poe", "Plato", "Ann Mark", "Éva Ös", "Phil Prater", "O'Neil Smith"]
    bits = ["Pastor", "ps.", "Rev", "dr. ", "sps.", "elder.", " ", "  ", " ", "\n", "'s", "’s", "’", ".", ",", "x", "1", "é", *[w for k in known for w in (k, *k.split(" "))], "AARON", "phil", "grace", "mark's", "ÉVA"]
    return known, ["".join(rng.choices(bits, k=rng.randrange(1, 9))) for _ in range(n)]


def test_against_expressions():
    known, texts = cases()
    finder = names.Finder(known)
    for text in texts:
        want = plain(text, known)
        got = [known[k] for k in finder.named(text)]
        assert got == want or len(want) > 1 and len(got) == 2 and set(got) <= set(want), text


def test_parts_give_the_same(spark):
    known, texts = cases(9, 150)
    rows = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "id int, text string")
    table = spark.createDataFrame([(k,) for k in [*known, known[0], None, ""]], "name string")
    want = {k: (plain(t, known)[0] if len(plain(t, known)) == 1 else None) for k, t in enumerate(texts)} | {900: None, 901: None}
    for part in (names.PART, 25):
        assert {r["id"]: r["name"] for r in names.named_one(rows, ["id"], "text", table, part=part).collect()} == want
    assert names.named_one(rows, ["id"], "text", table.limit(0)).where("name is not null").count() == 0


def test_many_names_make_no_longer_plan(spark):
    rows = spark.createDataFrame([(1, "Ask Name77 Zed.")], "id int, text string")
    few, many = (spark.range(n).selectExpr("concat('Name', id, 'x Zed', id, 'y') as name") for n in (5, 20_000))
    sizes = [len(names.named_one(rows, ["id"], "text", t)._jdf.queryExecution().toString()) for t in (few, many)]
    assert abs(sizes[0] - sizes[1]) < 200
    assert names.named_one(rows, ["id"], "text", many).first()["name"] is None
    assert names.named_one(rows.selectExpr("id", "'dr Name77x' as text"), ["id"], "text", many).first()["name"] == "Name77x Zed77y"
