"""Names of a table, found in texts: one pass over each text, however many names there are.

Each name gives phrases: itself, its last word, its first word. An automaton over all phrases reads a text once and
meets every place where one stands; what is around that place says whether it counts. Automata go to the tasks, so the
table is cut into parts of a bounded number of letters, and each part has an automaton and a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.refs import BOOK_NAMES

#: Letters of the names of one automaton, about; it takes some hundred bytes for each.
PART = 4_000_000
#: Titles that make a first name a person's, and those of them that may end in a dot.
TITLES = frozenset("pastor ps rev reverend dr elder bishop brother sister father fr deacon".split())
ABBREVIATED = frozenset("ps rev dr fr".split())
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
APOSTROPHES = str.maketrans("\u2019\u2018", "''")
#: How a phrase has to stand to name its owner.
ALONE, TITLED, OWNING = 1, 2, 4


def phrases(name: str) -> Iterator[tuple[str, int]]:
    """(phrase, ways): what names a person, in lower case. Names of books count neither alone as last names nor as owners."""
    low = name.lower()
    words = low.split(" ")
    yield low, ALONE
    if len(words) > 1 and len(words[-1]) >= 3 and words[-1] not in BOOK_NAMES:
        yield words[-1], ALONE
    if words[0]:
        yield words[0], TITLED if words[0] in BOOK_NAMES else TITLED | OWNING


class Finder:
    """The automaton of some names, told apart by numbers from 0."""

    def __init__(self, names: list[str]):
        ways: dict[str, dict[int, int]] = {}
        for k, name in enumerate(names):
            for phrase, way in phrases(name):
                own = ways.setdefault(phrase, {})
                own[k] = own.get(k, 0) | way
        self.automaton = ahocorasick.Automaton()
        for phrase, own in ways.items():
            # of owners in the same way two are enough to see that there are several
            kept: dict[int, int] = {}
            for way in (ALONE, TITLED, OWNING):
                for k in [k for k, w in own.items() if w & way][:2]:
                    kept[k] = kept.get(k, 0) | way
            if phrase:
                self.automaton.add_word(phrase, (len(phrase), list(kept.items())))
        if len(self.automaton):
            self.automaton.make_automaton()

    def named(self, text: str) -> list[int]:
        """Up to two of the names that a text names."""
        found: list[int] = []
        low = text.translate(APOSTROPHES).lower()
        for end, (size, owners) in self.automaton.iter(low) if len(self.automaton) else ():
            start, end = end + 1 - size, end + 1
            if start and low[start - 1].isalpha():
                continue
            after = low[end : end + 3]
            stands = ALONE if not after[:1].isalpha() else 0
            if stands and titled(low, start):
                stands |= TITLED
            if after[:2] == "'s" and not after[2:].isalpha():
                stands |= OWNING
            for k, ways in owners:
                if ways & stands and k not in found:
                    found.append(k)
            if len(found) > 1:
                return found[:2]
        return found


def titled(text: str, at: int) -> bool:
    """Whether a title and white space stand before a place of a text."""
    end = at
    while end and text[end - 1] in BLANKS:
        end -= 1
    if end == at:
        return False
    dotted = end > 0 and text[end - 1] == "."
    end -= dotted
    start = end
    while start and text[start - 1].isalpha():
        start -= 1
    return text[start:end] in (ABBREVIATED if dotted else TITLES)


def _parts(names: DataFrame, name: str, most: int) -> Iterator[list[str]]:
    """The names, in parts of about so many letters; the driver holds a part."""
    distinct = names.select(F.col(name).alias("name")).where(F.length("name") > 0).distinct()
    total = distinct.agg(F.sum(F.length("name"))).first()[0] or 0
    parts = -(-total // most) or 1
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    for k in range(parts):
        yield [r["name"] for r in dealt.where(F.col("part") == k).select("name").collect()]  # bounded by most


def named_one(texts: DataFrame, id_cols: list[str], text: Column | str, names: DataFrame, name: str = "name", part: int = PART) -> DataFrame:
    """(id_cols, name): the one name of a table that each text names; null for none and for several.

    A full name or a last name of three letters or more names its person where no letter is beside it, a first name
    after a title or with a possessive ending. Case does not matter. Names repeated in the table are one name. With
    one part the texts are not shuffled; with more, what the parts found is brought together by row, so id_cols have to tell rows
    apart then.
    """
    spark = texts.sparkSession
    rows = texts.select(*id_cols, (F.col(text) if isinstance(text, str) else text).alias("_text"))
    found = [_pass(spark, rows, id_cols, own) for own in _parts(names, name, part)]
    if len(found) == 1:
        return found[0].select(*id_cols, F.when(F.size("found") == 1, F.get("found", F.lit(0))).alias(name))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    merged = every.groupBy(*id_cols).agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))  # two names a part at most
    return merged.select(*id_cols, F.when(F.size("found") == 1, F.get("found", F.lit(0))).alias(name))


def _pass(spark: SparkSession, rows: DataFrame, id_cols: list[str], own: list[str]) -> DataFrame:
    sent = spark.sparkContext.broadcast(own)  # a part's names; each task builds the automaton once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        finder = Finder(names)
        for batch in batches:
            found = [[names[k] for k in finder.named(t)] if t else [] for t in batch.column(len(id_cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(found, pa.list_(pa.string()))], names=[*id_cols, "found"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", found array<string>")
