"""Clustering of integer vectors around centroids, exact in every assignment.

Distances are screened in single precision: one matrix product gives every inner product with an interval around
it that its rounding error cannot leave, whatever the order of summation. Centroids whose interval reaches below the
lowest upper end are a vector's shortlist. Only where more than one is on it are distances worked out again, in
exact integers, and of equal ones the lowest number wins. Vectors are dealt as they are read and never shuffled: a
round is one pass that sums up each centroid's vectors where they lie, and brings one row per centroid and task
together. Centroids, `k` of them, are all that the driver and the tasks hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

DIM, K, ROUNDS, SEED = 64, 40, 5, "2:"
#: Components of this size or more take no part; it keeps squares inside doubles.
TOO_LARGE = 2.0**500
#: Relative rounding of single precision.
UNIT = 2.0**-24
#: Sums travel in signed digits of so many bits, which a long can add up 2^23 of.
DIGIT = 40
LAST = 2**63 - 1


def whole(raw: np.ndarray) -> np.ndarray:
    """floor(256 x) as doubles, exact: scaling by a power of two and floor lose nothing."""
    return np.floor(256 * raw.astype(np.float64))


def shortlist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to which vector: a superset of the nearest ones, in rows of booleans.

    Both are scaled by powers of two first, so single precision neither overflows nor loses small components to more
    than its relative rounding. The score |c|^2 - 2 x.c orders centroids as the distance does.
    """
    n = x.shape[1]
    left, right = (np.exp2(-np.ceil(np.log2(np.maximum(np.abs(m).max(1), 1)))) for m in (x, c))
    dots = (x * left[:, None]).astype(np.float32) @ (c * right[:, None]).astype(np.float32).T
    dots = dots.astype(np.float64) / left[:, None] / right
    wide = n + 8  # the terms' own rounding, that of the inputs, and what doubles add afterwards
    gamma = wide * UNIT / (1 - wide * UNIT)
    sizes = [np.sqrt((m * m).sum(1)) for m in (x, c)]
    square = sizes[1] ** 2
    error = 2 * gamma * sizes[0][:, None] * sizes[1] + 2.0**-40 * square
    score = square - 2 * dots
    return score - error <= (score + error).min(1)[:, None]


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from rows of c, as longs where they fit, else as Python's integers."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) + 1
    if (2 * top) ** 2 * x.shape[1] < 2**62:
        apart = x.astype(np.int64) - c.astype(np.int64)
        return (apart * apart).sum(1)
    apart = np.array([[int(a) for a in row] for row in x], object).reshape(x.shape) - np.array([[int(a) for a in row] for row in c], object).reshape(c.shape)
    return (apart * apart).sum(1)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each vector; of equal distances the lowest number."""
    whole_c = np.array(centroids, object)
    c = whole_c.astype(np.float64)
    if np.abs(c).max(initial=0) < 2**53:
        whole_c = c
    near = shortlist(x, c)
    label = near.argmax(1)
    open_rows = np.flatnonzero(near.sum(1) > 1)
    at, number = np.nonzero(near[open_rows])
    if len(at):
        found = exact(x[open_rows[at]], whole_c[number])
        if found.dtype == object:
            order = np.array(sorted(range(len(at)), key=lambda i: (at[i], found[i], number[i])))
        else:
            order = np.lexsort((number, found, at))
        first = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))]
        label[open_rows[at[first]]] = number[first]
    return label, exact(x, whole_c[label])


def _kept(vec: str, dim: int) -> Column:
    return F.col(vec).isNotNull() & (F.size(vec) == dim) & F.forall(vec, lambda v: v.isNotNull() & (F.abs(v) < TOO_LARGE))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _sums(vectors: DataFrame, vec: str, centroids: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(count, component sums) of each centroid's vectors. A task sends a row per centroid and digit."""
    k, dim = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dim)
                label, _ = nearest(x, centroids)
                count += np.bincount(label, minlength=k)
                order = np.argsort(label, kind="stable")
                there, starts = np.unique(label[order], return_index=True)
                small = np.abs(x).max() < 2**62 / len(x)
                own = x.astype(np.int64) if small else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
                total[there] += np.add.reduceat(own[order], starts, axis=0).astype(object)
        rows, digit = [], 0
        used = np.flatnonzero(count)
        while len(used):
            low = (total[used] + (1 << DIGIT - 1)) % (1 << DIGIT) - (1 << DIGIT - 1)
            rows += [(int(j), digit, int(count[j]) if digit == 0 else 0, *map(int, own)) for j, own in zip(used, low)]
            total[used] = (total[used] - low) >> DIGIT
            used, digit = used[(total[used] != 0).any(1)], digit + 1
        names = ["cluster", "digit", "n", *(f"s{i}" for i in range(dim))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(dim + 3)], names=names)

    schema = "cluster long, digit long, n long, " + ", ".join(f"s{i} long" for i in range(dim))
    parts = vectors.select(vec).mapInArrow(run, schema)
    found = [[0, [0] * dim] for _ in range(k)]
    for row in parts.groupBy("cluster", "digit").agg(F.sum("n"), *(F.sum(f"s{i}") for i in range(dim))).collect():  # a row per centroid and digit
        own = found[row[0]]
        own[0] += row[2]
        own[1] = [a + (b << DIGIT * row[1]) for a, b in zip(own[1], row[3:])]
    return [(n, s) for n, s in found]


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM) -> list[list[int]]:
    """The centroids after so many rounds, numbered as they started; none if no vector is usable.

    They start as the k usable vectors whose `seed` + id have the smallest sha256 hex digests, in that order; rows that
    share an id are told apart by their components, and those without an id come last. In each round every vector goes
    to its nearest centroid, and each centroid that has any becomes the floor of its vectors' mean by component.
    """
    usable = vectors.where(_kept(vec_col, dim)).select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec"))
    key = F.sha2(F.concat(F.lit(seed), F.col("_id").cast("string")), 256)
    first = usable.select(key.alias("_key"), "_vec").orderBy(F.asc_nulls_last("_key"), "_vec").limit(k).collect()
    centroids = [[int(v) for v in whole(np.array(r["_vec"]))] for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = [[s // n for s in sums] if n else old for old, (n, sums) in zip(centroids, _sums(usable, "_vec", centroids))]
    return centroids


def assigned(vectors: DataFrame, centroids: list[list[int]], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance): the nearest centroid of each usable vector and the squared distance from it.

    A distance beyond a long is given as the largest one.
    """
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label, distance = nearest(_matrix(batch.column(1), dim), centroids)
                far = [min(int(d), LAST) for d in distance] if distance.dtype == object else distance
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.int32()), pa.array(far, pa.int64())], names=[id_col, "cluster", "distance"])

    rows = vectors.where(_kept(vec_col, dim)).select(F.col(id_col).cast("long").alias(id_col), vec_col)
    return rows.mapInArrow(run, f"`{id_col}` long, cluster int, distance long")


def op13(vectors: DataFrame) -> DataFrame:
    """One row per vector with exactly 64 components, none null or not finite.

    Null, empty and shorter or longer vectors take no part, nor do those with a component of 2^500 or more (which a
    float cannot hold). Rows that repeat or share an id are vectors of their own, as are those without an id. With fewer
    than 40 usable vectors there are as many centroids as vectors; an empty table gives an empty result. Ties go to
    the lowest centroid number. Distances and their sums beyond a long are given as the largest long. Other columns,
    whatever their names, are not read.
    """
    centroids = fit(vectors)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = materialize(assigned(vectors, centroids), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per centroid
    total = min(sum(sums.values()), LAST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = [(j, min(s, LAST), total, digest[j]) for j, s in sums.items()]
    table = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most K rows


def op13_sql() -> str:
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = f"select n, vec_id, x, k, d from (select v.n, v.vec_id, v.x, c.k, {apart} as d, row_number() over (partition by v.n order by {apart}, c.k) as i from v, {{}} c) where i = 1"
    steps = []
    for r in range(ROUNDS):
        steps += [
            f"a{r} as ({near.format(f'c{r}')})",
            f"s{r} as (select k, i, sum(x[i]) as s, count(*) as m from (select k, x, unnest(generate_series(1, {DIM})) as i from a{r}) group by k, i)",
            f"m{r} as (select k, list(cast((s - ((s % m) + m) % m) // m as bigint) order by i) as x from s{r} group by k)",
            f"c{r + 1} as (select c.k, coalesce(m.x, c.x) as x from c{r} c left join m{r} m on m.k = c.k)",
        ]
    return f"""
    with v as materialized (
      select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
      from embeddings where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    c0 as materialized (
      select cast(row_number() over (order by h nulls last, x) - 1 as integer) as k, x
      from (select sha256('{SEED}' || vec_id) as h, x from v) order by k limit {K}),
    {", ".join(s.replace(" as (", " as materialized (", 1) for s in steps)},
    f as (select vec_id, k, d, x from ({near.format(f"c{ROUNDS}")}))
    select f.vec_id, f.k as cluster, cast(f.d as bigint) as distance, cast(sum(f.d) over (partition by f.k) as bigint) as cluster_inertia,
      cast(sum(f.d) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
    from f join c{ROUNDS} c on c.k = f.k"""
