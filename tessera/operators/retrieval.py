"""Search results as readable sources: hits, their neighbours, merged runs, a budget, numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import folds


@dataclass(frozen=True)
class Limits:
    hits: int = 8
    before: int = 2
    after: int = 2
    max_chars: int = 60_000

    @property
    def longest_run(self) -> int:
        return max(4, self.before + self.after + 1)


#: The most hits that a search fetches where some are to be skipped, and how many times the wanted ones it fetches then.
MOST_FETCHED, FETCHED_TIMES = 100, 3


def unskipped(found: DataFrame, skip: DataFrame | None, limits: Limits, by: list[str], doc: str = "doc_id", kept_by: list[str] | None = None) -> DataFrame:
    """The first limits.hits of found (by, doc, ..., rank) whose documents are not in skip (kept_by, doc), ranked anew.

    found holds the best min(MOST_FETCHED, FETCHED_TIMES x hits) where there is something to skip, as fetched() says.
    What is skipped is kept for each question, or by other columns of found, such as an asker's.
    """
    key = [*(by if kept_by is None else kept_by), doc]
    kept = found if skip is None else found.join(skip.select(*key).distinct(), key, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limits.hits)


def fetched(limits: Limits, skips: bool) -> int:
    """How many hits to fetch so that enough are left."""
    return min(MOST_FETCHED, FETCHED_TIMES * limits.hits) if skips else limits.hits


def sources(hits: DataFrame, chunks: DataFrame, limits: Limits = Limits(), doc: str = "doc_id", seq: str = "seq", by: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """(by, doc, first, last, rank, n_chars, text, number): sources for each question's hits (by, doc, seq, rank).

    Chunks (doc, seq, text) beside a hit come with it, from number 1 on and, given a kind, only transcript ones;
    consecutive ones join into runs; a run has the rank of its best hit; runs are kept in that order while they fit
    the budget, the first one always. Questions are told apart by the columns `by`; without them there is one.
    """
    by = by or []
    around = F.explode(F.sequence(F.greatest(F.lit(1), F.col(seq) - limits.before), F.greatest(F.lit(1), F.col(seq) + limits.after))).alias(seq)
    near = hits.select(*by, doc, around).withColumn("_hit", F.lit(None).cast("int"))
    wanted = near.unionByName(hits.select(*by, doc, seq, F.col("rank").cast("int").alias("_hit"))).groupBy(*by, doc, seq).agg(F.min("_hit").alias("_hit"))
    marked = chunks.join(wanted, [doc, seq])
    if kind is not None:
        marked = marked.where(F.col("_hit").isNotNull() | (F.col(kind) == "transcript"))
    out = folds.merge_runs(marked, [*by, doc], seq, limits.longest_run, "text", kind, best="_hit")
    sized = out.withColumn("n_chars", F.length("text"))
    order = [F.asc_nulls_last("rank"), doc, "first"]
    kept = folds.prefix_budget(sized, by, order, "n_chars", limits.max_chars)
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).drop("n")


def hybrid(keyword: DataFrame, semantic: DataFrame, most: int = 12, key: str = "doc_id") -> DataFrame:
    """(key, kind, rank): keyword matches, then the best documents that only the meaning finds (key, rank)."""
    best = semantic.groupBy(key).agg(F.min("rank").alias("rank"))
    fresh = best.join(keyword.select(key), key, "left_anti").orderBy("rank", key).limit(most)
    ranked = F.row_number().over(Window.orderBy("rank", key))
    return keyword.select(key, F.lit("keyword").alias("kind"), F.lit(None).cast("int").alias("rank")).union(fresh.select(key, F.lit("meaning"), ranked))


#: Documents that a scope may have to be sent whole.
MAX_WHOLE = 40


def policy(n_docs: Column, chars: Column, budget: Column, pinned_chars: Column | None = None, mode: Column | None = None) -> Column:
    """(way, note): how to answer, and what to say where whole texts were asked for and do not fit.

    Pinned texts go whole if they fit the budget, with the rest of the scope searched. A scope of 1 to MAX_WHOLE
    documents that fits goes whole, unless the mode is 'search'. n_docs is null for a question without a scope.
    """
    pinned = F.coalesce(pinned_chars if pinned_chars is not None else F.lit(0), F.lit(0))
    mode = F.coalesce(mode if mode is not None else F.lit("auto"), F.lit("auto"))
    narrow = n_docs.between(1, MAX_WHOLE) & (mode != "search")
    fits = F.coalesce(narrow & (chars <= budget), F.lit(False))
    way = F.when((pinned > 0) & (pinned <= budget), "pinned").when(fits, "whole").otherwise("search")
    note = F.when((way != "pinned") & (pinned > 0) & (way == "search"), "pinned texts too long")
    note = F.coalesce(note, F.when((way == "search") & (mode == "full"), F.when(F.coalesce(narrow, F.lit(False)), "scope too long").otherwise("scope too wide")))
    return F.struct(way.alias("way"), note.alias("note"))


def numbered(groups: list[DataFrame], order: list[str], parts: int = 64) -> DataFrame:
    """Lists one after another, numbered from 1 without gaps."""
    out = groups[0].withColumn("_group", F.lit(0))
    for k, g in enumerate(groups[1:], 1):
        out = out.unionByName(g.withColumn("_group", F.lit(k)))
    return folds.numbered_by(out, [F.col("_group"), *(F.col(c) for c in order)], "number", parts).drop("_group")


def stored(rows: DataFrame, text: str = "text", most: int = 600) -> DataFrame:
    """Sources as they are kept with an answer: texts cut, without inner ids."""
    return rows.withColumn(text, F.substring(text, 1, most)).drop("chunk_id")
