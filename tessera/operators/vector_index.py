"""An index of vectors in clusters, searched exactly.

Centres are fitted on a bounded sample; every vector goes to the nearest one and keeps its angle from it. Angles obey the
triangle inequality: a vector at angle t from a centre that a query is at angle a from is at least |a - t| away from the
query. So a query first asks the clusters around it, which gives it a k-th best score, and then only those clusters, and
of their vectors only the ring of angles, that can still hold a better one. What the index passes over cannot be in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import tables
from tessera.operators.vectors import MAX_QUERIES, _matrix

#: Vectors that centres are fitted on, and the most centres there are. All vectors are indexed.
SAMPLE, MOST = 20_000, 1024
STEPS = 12
#: Scores have six places; a bound has to be lower by more than that can hide.
SLACK = 2e-6


class Index(NamedTuple):
    """rows (cluster, angle, id, embedding) sorted by cluster and angle; vectors of another length than the centres are in cluster -1."""

    rows: DataFrame
    centres: np.ndarray
    #: By cluster: how many vectors, and the least and largest angle.
    sizes: np.ndarray
    least: np.ndarray
    most: np.ndarray
    total: int


def fitted(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k centres of unit vectors, by repeated means; a centre that loses all its vectors starts anew at the worst placed one."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(STEPS):
        score = x @ centres.T
        own = score.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        lost = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        sums[lost] = x[np.argsort(score.max(1), kind="stable")[: len(lost)]]
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def build(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", clusters: int | None = None) -> Index:
    """The index of all vectors with a direction, about as many clusters as the root of their number.

    It is written to the shared folder. Vectors without a direction are no one's neighbours and are left out.
    """
    known = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull())
    sample = _matrix(known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"])
    dim = max(sample, key=lambda d: len(sample[d][0]), default=1)
    x = sample[dim][1] if sample else np.empty((0, dim))
    count = known.count()
    k = min(MOST, len(x), clusters or max(1, round(count**0.5)))
    centres = fitted(x, k) if k else np.empty((0, dim))
    sent = vectors.sparkSession.sparkContext.broadcast(centres)  # MOST centres

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, angle, kept = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for length, (at, unit) in _matrix(batch.column(1)).items():
                kept[at] = True
                if length == sent.value.shape[1] and len(sent.value) and len(at):
                    angles = _angles(unit, sent.value)
                    cluster[at], angle[at] = angles.argmin(1), angles.min(1)
            columns = [pa.array(cluster, pa.int32()), pa.array(angle), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "angle", "id", "embedding"]).filter(pa.array(kept))

    placed = known.mapInArrow(place, "cluster int, angle double, id long, embedding array<double>")
    rows = tables.written(placed.repartitionByRange("cluster", "angle").sortWithinPartitions("cluster", "angle"), "index")
    sizes, least, most = np.zeros(k, np.int64), np.full(k, np.pi), np.zeros(k)
    found = rows.groupBy("cluster").agg(F.count(F.lit(1)), F.min("angle"), F.max("angle")).collect()  # a row per centre
    for cluster, n, low, high in found:
        if cluster >= 0:
            sizes[cluster], least[cluster], most[cluster] = n, low, high
    return Index(rows, centres, sizes, least, most, sum(r[1] for r in found))


def _hits(index: Index, query_ids: np.ndarray, queries: dict, asks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, scored: Accumulator | None) -> DataFrame:
    """(query_id, id, score): of each task the k best of what asks names: by cluster, queries with the least and largest angle."""
    spark = index.rows.sparkSession
    sent = spark.sparkContext.broadcast((query_ids, queries, asks))  # MAX_QUERIES queries at most, and what they ask of MOST clusters

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, queries, asks = sent.value
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count = 0
        for batch in batches:
            cluster, angle, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            for dim, (at, unit) in _matrix(batch.column(3)).items():
                q_at, q = queries.get(dim, ((), None))
                row_of = {int(a): r for r, a in enumerate(q_at)}
                for own in np.unique(cluster[at]).tolist():
                    here = np.flatnonzero(cluster[at] == own)
                    here = here[np.argsort(angle[at[here]], kind="stable")]
                    turned = angle[at[here]]
                    who, low, high = asks.get(own, ((), (), ()))
                    for query, a, b in zip(who, np.searchsorted(turned, low), np.searchsorted(turned, high, "right")):
                        if query in row_of and a < b:
                            count += int(b - a)
                            score = np.round(unit[here[a:b]] @ q[row_of[query]], 6)
                            own_ids = ids[at[here[a:b]]]
                            if len(score) > k:
                                floor = -np.partition(-score, k - 1)[k - 1]
                                score, own_ids = score[score >= floor], own_ids[score >= floor]
                            best.setdefault(int(query), []).append((score, own_ids))
            for query, parts in best.items():
                if len(parts) > 16:
                    best[query] = [_first(parts, k)]
        if scored is not None:
            scored.add(count)
        for query, parts in best.items():
            score, own_ids = _first(parts, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), ids_of[query])), pa.array(own_ids), pa.array(score)], names=["query_id", "id", "score"])

    wanted = [c for c in asks if len(asks[c][0])]
    rows = index.rows.where(F.col("cluster").isin(wanted)) if wanted else index.rows.limit(0)
    return rows.select("cluster", "angle", "id", "embedding").mapInArrow(search, "query_id long, id long, score double")


def _first(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def nearest(index: Index, queries: DataFrame, k: int, scored: Accumulator | None = None, most: int = MAX_QUERIES) -> DataFrame:
    """(query_id, id, score, rank): as vectors.nearest, from an index. scored adds up how many pairs were compared.

    Queries are answered so many at a time.
    """
    spark = index.rows.sparkSession
    asked = queries.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>").alias("query"))
    blocks = -(-asked.count() // most) or 1
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        held = dealt.where(F.col("_block") == block).select("query_id", "query").toArrow()  # about `most` rows
        query_ids, own = held["query_id"].to_numpy(), _matrix(held["query"]) if held.num_rows else {}
        at, q = own.get(index.centres.shape[1], (np.empty(0, np.int64), np.empty((0, index.centres.shape[1]))))
        angle = _angles(q, index.centres)
        order = np.argsort(angle, axis=1, kind="stable")
        need = (np.cumsum(index.sizes[order], axis=1) < k).sum(1) + 1  # clusters that hold k vectors
        home = np.zeros(angle.shape, bool)
        for r, n in enumerate(need):
            home[r, order[r, :n]] = True
        every = np.concatenate([a for a, _ in own.values()]) if own else np.empty(0, np.int64)
        wide = lambda rows, n: (rows, np.zeros(n), np.full(n, np.pi + 1))
        asks = {c: wide(at[home[:, c]], int(home[:, c].sum())) for c in range(len(index.sizes))} | {-1: wide(every, len(every))}
        first = tables.written(_hits(index, query_ids, own, asks, k, scored), "hits")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        floors = {r[0]: r[1] for r in first.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("query_id", "score").collect()}  # a row a query
        floor = np.array([floors.get(i, -2.0) for i in query_ids[at].tolist()])
        reach = np.where(floor > -1, np.arccos(np.clip(floor - SLACK, -1, 1)) + 1e-7, np.pi + 1)[:, None]
        may = ~home & (angle - reach <= index.most) & (angle + reach >= index.least) & (index.sizes > 0)
        asks = {c: (at[rows], (angle - reach)[rows, c], (angle + reach)[rows, c]) for c in range(len(index.sizes)) if len(rows := np.flatnonzero(may[:, c]))}
        hits = first.unionByName(_hits(index, query_ids, own, asks, k, scored)) if asks else first
        found = hits if found is None else found.unionByName(hits)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
