"""Exact top-k inner products by MaxScore over shards.

A term is a dimension and a sign; its postings are the vectors whose component has that sign, its impact the
component's size. A query's terms are its dimensions with its own signs, and only they can add to a score. A shard
splits the query's terms by their bounds: the weakest ones whose bounds together stay below the k-th best score so
far are non-essential. Vectors in no essential posting cannot enter the result and are passed over; the others
get their essential dimensions first, and each further group of dimensions only while the bound of what remains
keeps them competitive. The floor rises as results come in, and the split with it. Shards' results are merged.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

K = 5
#: Candidates of a shard and queries of a block, about; both are dealt by a hash of the id.
SHARD, QUERIES = 4096, 2048
#: Vectors scored outright to start with, from the strongest terms, and dimensions probed at a time.
SEEDS, PROBE = 32, 8
#: Candidates between the first two splits of the terms.
BLOCK = 512
#: The largest score, and more than the size of any inner product of doubles times 256.
LAST, HUGE = 2**63 - 1, 10**699


class Shard:
    """The postings of candidate vectors, all of one length; rows tell candidates apart, ids are what ties go by."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.x = rows, ids, x
        self.top = np.maximum(np.stack([x.max(0), -x.min(0)]), 0)  # by sign: strongest impact of each dimension
        strong = min(SEEDS, len(rows))
        rank = np.argsort(x, axis=0, kind="stable")
        self.strong = np.stack([rank[::-1][:strong], rank[:strong]])  # by sign: vectors of strongest impact
        self.cuts = BLOCK * (2 ** np.arange(1, 32) - 1)  # blocks double, as the floor rises most at first

    def search(self, row: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best candidates but the query's own row; ties go to smaller ids.

        Candidates come in blocks, those of strongest impact first. After each block the floor is the k-th best score
        so far, and the terms are split anew, so ever more vectors are passed over.
        """
        sign = (q < 0).astype(np.int64)
        dims = np.arange(len(q))
        bound = np.abs(q) * self.top[sign, dims]
        order = np.argsort(bound, kind="stable")  # weakest first
        weak = np.cumsum(bound[order])
        seeds = np.unique(self.strong[sign[order[-4:]], :, order[-4:]])
        others = np.delete(np.arange(len(self.rows)), seeds)
        best: list[tuple[int, int]] = []
        for block in [seeds, *np.split(others, self.cuts[self.cuts < len(others)])]:
            at = block[self.rows[block] != row]
            floor = -best[-1][0] if len(best) == k else None
            split = int(np.searchsorted(weak, floor, "left")) if floor is not None and floor > 0 else 0
            essential, rest = order[split:], order[:split][::-1]  # the rest strongest first
            if split:  # who is in no essential posting scores less than the floor
                at = at[(self.x[np.ix_(at, essential)] * (1 - 2 * sign[essential]) > 0).any(1)]
            score = self.x[np.ix_(at, essential)] @ q[essential]
            for i in range(0, len(rest), PROBE):
                live = score + bound[rest[i:]].sum() >= floor
                at, own = at[live], rest[i : i + PROBE]
                score = score[live] + self.x[np.ix_(at, own)] @ q[own]
            if floor is not None:
                at, score = at[score >= floor], score[score >= floor]
            best = sorted(best + [(-int(s), int(i)) for s, i in zip(score, self.ids[at])])[:k]
        return [(i, -s) for s, i in best]


def _whole(vectors: list) -> np.ndarray:
    """floor(256 x) of vectors of one length: as doubles where their inner products stay exact in these, else as Python's integers."""
    raw = np.stack(vectors).astype(np.float64)
    top = float(np.abs(raw).max(initial=0)) + 1
    if (256 * top) ** 2 * raw.shape[1] < 2**53:
        return np.floor(256 * raw)
    return np.array([[math.floor(256 * Fraction(c)) for c in v] for v in raw.tolist()], dtype=object)


def _search_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Queries (left) against one shard (right)."""
    out: list[tuple[int, int, int, int, float]] = []
    for dim in left["x"].map(len).unique() if len(left) and len(right) else ():
        queries, rows = left[left["x"].map(len) == dim], right[right["other_x"].map(len) == dim]
        if not len(rows):
            continue
        both = _whole([*queries["x"], *rows["other_x"]])
        q, shard = both[: len(queries)], Shard(rows["other_row"].to_numpy(), rows["other_id"].to_numpy(), both[len(queries) :])
        for row, query_id, vector in zip(queries["row"].tolist(), queries["id"].tolist(), q):
            # scores beyond 64 bits are given as the ends of that range, but still come in their order
            out += [(row, query_id, i, min(max(s, -LAST), LAST), f"{s + HUGE:0700d}" if abs(s) > LAST else "") for i, s in shard.search(row, vector, K)]
    return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score", "beyond"]).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64", "beyond": "object"})


def top_k(vectors: DataFrame, every: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the K best of all other rows for each row whose id is divisible by every.

    Components are floor(256 x). Rows with a null id or vector, or with null or non-finite components, and empty
    vectors take no part; vectors meet only those of their own length. Rows that share an id are separate: each is
    a candidate for all rows but itself, and each is a query of its own, so its query_id has K rows for each. A query
    with fewer than K others gets them all; an empty table gives an empty result. Scores beyond 64 bits are ranked by
    their true values and given as the ends of the range. Other columns, whatever their names, are not read.
    Queries meet all rows in blocks: each pair of a query block and a shard is one task's work, of bounded size.
    """
    finite = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_query = F.col("id") % every == 0
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    shards, blocks = -(-size["n"] // SHARD) or 1, -(-size["q"] // QUERIES) or 1
    queries = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    others = rows.select(*(F.col(c).alias(f"other_{c}") for c in rows.columns)).withColumn("shard", F.pmod(F.xxhash64("other_row"), F.lit(shards)).cast("int"))
    others = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "row long, query_id long, vec_id long, score long, beyond string"
    near = queries.groupBy("block", "shard").cogroup(others.groupBy("block", "shard")).applyInPandas(_search_block, schema)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def op5(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, every=50)


OP5_SQL = """
    with v as (
      select row_number() over () as n, vec_id as id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
      from embeddings
      where vec_id is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (
      select q.n, q.id as query_id, c.id as vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
      from v q, v c where q.id % 50 = 0 and q.n <> c.n and len(q.x) = len(c.x)),
    r as (select query_id, cast(row_number() over (partition by n order by score desc, vec_id) as integer) as rank, vec_id, score from s)
    select query_id, rank, vec_id, score from r where rank <= 5"""
