"""Exact nearest neighbours by cosine, and the index table they are searched in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that travel to all vectors at once; more of them meet the vectors in blocks.
MAX_QUERIES = 4096
#: Vectors of a part where queries come in blocks, about.
PART = 16_384
#: Queries of one matrix product, and its scores, at most but for one query's; a few copies of it are held at once.
PRODUCT, SCORES = 256, 1 << 20
#: Hits that a search over many ids fetches before it filters, in the lossy mode.
OVERFETCH = 100


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions and unit vectors of those that have a direction."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    out = {}
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        x = flat[offsets[at][:, None] + np.arange(dim)].astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        out[dim] = at[good], x[good] / norm[good, None]
    return out


def _best(asked: tuple[np.ndarray, dict], ids: np.ndarray, known: dict, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score) of the k nearest of a batch for each query, by matrix products of bounded size."""
    query_ids, queries = asked
    for dim, (at, x) in known.items():
        q_at, q = queries.get(dim, (np.empty(0, np.int64), None))
        own = ids[at]
        order = np.argsort(own, kind="stable")  # a stable sort by score then leaves ties by id
        own, x = own[order], x[order]
        step = min(PRODUCT, max(1, SCORES // max(1, len(own))))
        for s in range(0, len(q_at) if len(own) else 0, step):
            scores = np.round(q[s : s + step] @ x.T, 6)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k] if len(own) <= 4 * k else _top(scores, k)
            rows = np.repeat(np.arange(len(scores)), top.shape[1])
            columns = [query_ids[q_at[s + rows]], own[top.ravel()], scores[rows, top.ravel()]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score"])


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row, ties to smaller places."""
    floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(scores), k), np.int64)
    for r, (row, f) in enumerate(zip(scores, floor)):
        at = np.flatnonzero(row >= f)
        out[r] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors of each query (query_id, query), by cosine to six places, ties by id.

    Scores are matrix products over Arrow batches; of each batch only every query's k best are shuffled. Up to
    max_queries queries travel to the tasks whole. More are dealt into blocks of about that many, which meet the
    vectors part by part. Vectors without a direction, and those of another length than a query, are no neighbours.
    """
    spark = vectors.sparkSession
    known = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("embedding"))
    asked = queries.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>").alias("query"))
    few = asked.limit(max_queries + 1).toArrow()  # bounded; one more than may travel tells if there are more
    schema = "query_id long, id long, score double"
    if few.num_rows <= max_queries:
        held = few["query_id"].to_numpy(), _matrix(few["query"]) if few.num_rows else {}
        sent = spark.sparkContext.broadcast(held)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _best(sent.value, batch.column(0).to_numpy(), _matrix(batch.column(1)), k)

        near = known.mapInArrow(score, schema)
    else:
        sizes = known.agg(F.count(F.lit(1)).alias("n")).first()["n"], asked.count()
        parts, blocks = max(1, -(-sizes[0] // PART)), max(1, -(-sizes[1] // max_queries))
        deal = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
        left = asked.withColumn("block", deal("query_id", blocks, 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = known.withColumn("part", deal("id", parts, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def meet(q: pa.Table, v: pa.Table) -> pa.Table:
            found = list(_best((q["query_id"].to_numpy(), _matrix(q["query"])), v["id"].to_numpy(), _matrix(v["embedding"]), k)) if q.num_rows and v.num_rows else []
            return pa.Table.from_batches(found, pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

        near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


#: Ids that a hosted index takes in a filter; a longer list filters what an over-fetch found.
MAX_FILTER_IDS = 40


def nearest_in(
    vectors: DataFrame, queries: DataFrame, k: int, ids: DataFrame | None, id_col: str = "vec_id", vec: str = "embedding", overfetch: bool | None = False, apart: DataFrame | None = None
) -> DataFrame:
    """As nearest, among the ids of a table; no table: all but those apart, such as another corpus in the same index.

    An empty table of ids finds nothing. Ids are filtered before scoring, so nothing is lost. overfetch gives the
    lossy way of hosted indexes instead: the best OVERFETCH of all, then the filter; None chooses that way where
    there are more than MAX_FILTER_IDS ids, as such an index must.
    """
    if ids is None:
        others = vectors if apart is None else vectors.join(apart.select(id_col), id_col, "left_anti")
        return nearest(others, queries, k, id_col, vec)
    if overfetch is None:
        overfetch = ids.select(id_col).distinct().limit(MAX_FILTER_IDS + 1).count() > MAX_FILTER_IDS
    if not overfetch:
        return nearest(vectors.join(ids, id_col, "left_semi"), queries, k, id_col, vec)
    others = vectors if apart is None else vectors.join(apart.select(id_col), id_col, "left_anti")
    hits = nearest(others, queries, OVERFETCH, id_col, vec).join(ids.withColumnRenamed(id_col, "id"), "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def indexed_text(label: Column, text: Column) -> Column:
    """What is embedded: the label on a line of its own before the text. What is stored stays bare."""
    return F.concat_ws("\n", label, text)


def upsert_vectors(old: DataFrame, new: DataFrame, stale: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """The index after new rows replace those of their key and stale keys go; buckets.upsert does so in place."""
    kept = old.join(new.select(key), key, "left_anti").unionByName(new)
    return kept if stale is None else kept.join(stale.select(key), key, "left_anti")
