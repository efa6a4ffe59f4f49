"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; a table's bucket is the tuple of its quantised
projections. At cosine 0.9 two unit vectors lie 0.447 apart; one projection of width 2 then keeps them together with
probability 0.82, fourteen with 0.062, and one of forty tables with 0.92 (0.98 at cosine 0.92, 1.00 from 0.95).

What travels to the buckets is not the vector but its number and the signs of 256 further projections. Members of a
bucket whose signs differ in at most LIMIT places are joined by a spanning forest (at cosine 0.9 about 37 differ, so
70 loses one link in 10^8; of unrelated pairs one in 10^12 passes). Vectors that these forests connect are fetched
once, and all of them are compared exactly, in double precision and in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from tessera.llm.common import components, least_names, materialize, spread_join

COSINE = 0.9
TABLES, HASHES, WIDTH, SEED = 40, 14, 2.0, 11
SIGNS, LIMIT = 256, 70
#: Members of one bucket, and of what buckets connect, that are compared at once; larger ones meet block against block.
BLOCK, MATCHED = 1024, 256
#: Groups up to this size are screened together.
SMALL = 64


def directions(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.standard_normal((dim, TABLES * HASHES))
    b = rng.uniform(0, WIDTH, TABLES * HASHES)
    odd = rng.integers(1 << 62, size=(TABLES, HASHES), dtype=np.int64) * 2 + 1
    return a, b, odd, rng.standard_normal((dim, SIGNS))


def bucket_keys(unit: np.ndarray) -> np.ndarray:
    """The bucket of each unit vector in each table, as a 64-bit mix of its quantised projections with table and length."""
    a, b, odd, _ = directions(unit.shape[1])
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, HASHES)
    mixed = ((cells * odd).sum(2) + odd[:, 0] * unit.shape[1]).view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def signs(unit: np.ndarray) -> np.ndarray:
    """The signs of further projections, packed in 64-bit words."""
    return np.packbits(unit @ directions(unit.shape[1])[3] > 0, axis=1).view(np.int64)


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors, in double precision, of a column of usable vectors, by their length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        x = flat[offsets[at][:, None] + np.arange(dim)].astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
        yield at, x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, embedding) to (rep, keys, signs)."""
    for batch in batches:
        for at, unit in _units(batch.column(1)):
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in (bucket_keys(unit), signs(unit))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *lists], names=["rep", "keys", "signs"])


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by names as tables of whole groups, with the bounds of the groups; holds a batch and an open group."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        key = np.stack([table[c].to_numpy() for c in names], 1)
        new = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if held and (np.array([held[-1][c][-1].as_py() for c in names]) != key[0]).any():
            new = np.concatenate(([0], new))
        if not len(new):
            held.append(table)
            continue
        whole = pa.concat_tables([*held, table.slice(0, new[-1])])
        held = [table.slice(new[-1])]
        yield whole, _bounds(whole, names)
    if held:
        whole = pa.concat_tables(held)
        yield whole, _bounds(whole, names)


def _bounds(table: pa.Table, names: list[str]) -> np.ndarray:
    key = np.stack([table[c].to_numpy() for c in names], 1)
    return np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))


def _forest(n: int, near) -> list[tuple[int, int]]:
    """Edges that connect what is connected among n members; near(i, others) tells which of the others are i's neighbours."""
    edges, new = [], np.ones(n, bool)
    for root in range(n):
        if not new[root]:
            continue
        new[root], stack = False, [root]
        while stack:
            others = np.flatnonzero(new)
            if not len(others):
                return edges
            i = stack.pop()
            found = others[near(i, others)]
            new[found] = False
            edges += [(i, j) for j in found.tolist()]
            stack += found.tolist()
    return edges


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, i, j, rep, s0 to s3) to edges (u, v) between members whose signs are close."""
    for table, bounds in _groups(batches, ["bucket", "i", "j"]):
        rep = table["rep"].to_numpy()
        bits = np.stack([table[f"s{k}"].to_numpy() for k in range(SIGNS // 64)], 1).view(np.uint64)
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        some = set(np.flatnonzero(sizes > SMALL).tolist())
        left = np.flatnonzero(sizes[group] <= SMALL)
        step = 1
        while len(left := left[left + step < len(rep)]) and len(left := left[group[left] == group[left + step]]):
            close = np.bitwise_count(bits[left] ^ bits[left + step]).sum(1, dtype=np.int64) <= LIMIT
            some.update(group[left[close]].tolist())
            step += 1
        out: list[tuple[int, int]] = []
        for g in sorted(some):
            own, ids = bits[bounds[g] : bounds[g + 1]], rep[bounds[g] : bounds[g + 1]]
            edges = _forest(len(own), lambda i, others: np.bitwise_count(own[others] ^ own[i]).sum(1, dtype=np.int64) <= LIMIT)  # noqa: B023
            out += [(int(ids[a]), int(ids[b])) for a, b in edges]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (component, i, j, block, rep, mult, embedding) to (rep, n, other): numbers of links, and edges with n null."""
    for table, bounds in _groups(batches, ["component", "i", "j"]):
        i, j, block, rep, mult = (table[c].to_numpy() for c in ("i", "j", "block", "rep", "mult"))
        out: list[tuple] = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            for at, unit in _units(table["embedding"].slice(s, e - s)):
                at = at + s
                linked = unit @ unit.T >= COSINE
                np.fill_diagonal(linked, False)
                if i[s] != j[s]:
                    linked &= block[at][:, None] != block[at][None, :]
                n = linked @ mult[at]
                out += [(int(r), int(x), None) for r, x in zip(rep[at], n) if x]
                some = np.flatnonzero(n)
                out += [(int(rep[at[some[a]]]), None, int(rep[at[some[b]]])) for a, b in _forest(len(some), lambda k, others: linked[some[k], some[others]])]  # noqa: B023
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["rep", "n", "other"])


def _dealt(rows: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """rows with block, i and j added: groups of more than `most` rows are in blocks of about so many, and each pair of blocks meets."""
    big = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    big = materialize(big.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_blocks")), "big")
    blocks = F.coalesce("_blocks", F.lit(1))
    rows = rows.join(big, key, "left").withColumn("block", F.pmod(F.xxhash64(member), blocks).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    return rows.withColumn("i", F.least("block", "_with")).withColumn("j", F.greatest("block", "_with")).drop("_with")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of vectors; other columns, whatever their names, are not read.

    Links join vectors of the same length with cosine COSINE or more. Null, empty and zero vectors, and those with
    null or non-finite components, link with nothing and are their own component. Equal vectors (told by 128 bits of
    hash) meet in one class first and count as linked to each other; an id that occurs more than once keeps a row for
    each occurrence, each counted. Rows with a null id count as links of others but name no component; their
    component_id is null where nothing else is in it. An empty table gives an empty result.
    """
    kind = vectors.select(F.col(vec_col).alias("e")).schema["e"].dataType
    vector = F.col(vec_col) if isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType)) else F.col(vec_col).cast("array<double>")
    usable = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x)).alias("e"))
    rows = materialize(rows.select("id", F.when(usable, F.col("e")).alias("embedding")).select("id", "embedding", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")).alias("h"), F.xxhash64(F.lit(7), "embedding").alias("g")), "vectors")

    classes = rows.where("h is not null").groupBy("h", "g").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding"))
    # numbered once, as it is written
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    hashed = materialize(classes.select("rep", "embedding").mapInArrow(_hashed, "rep long, keys array<long>, signs array<long>"), "hashed")
    index = hashed.select(F.explode("keys").alias("bucket"), "rep", *(F.col("signs")[k].alias(f"s{k}") for k in range(SIGNS // 64)))
    met = _dealt(index, "bucket", "rep", BLOCK).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").select("bucket", "i", "j", "rep", *(f"s{k}" for k in range(SIGNS // 64)))
    near = materialize(met.mapInArrow(_connected, "u long, v long"), "near")

    joined = materialize(components(near).withColumnRenamed("node", "rep"), "joined")
    groups = _dealt(joined, "component", "rep", MATCHED).join(classes.select("rep", "mult", "embedding"), "rep")
    groups = groups.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").select("component", "i", "j", "block", "rep", "mult", "embedding")
    found = materialize(groups.mapInArrow(_linked, "rep long, n long, other long"), "links")

    counts = found.where("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    edges = found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v"))
    labels = least_names(classes.select("rep", "first"), "rep", "first", edges).select(F.col("node").alias("rep"), "name")
    done = classes.select("rep", "h", "g", "first", "mult").join(counts, "rep", "left").join(labels, "rep", "left")
    done = done.select("h", "g", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("name", "first").alias("component_id"))
    out = spread_join(rows.where("h is not null").select("id", "h", "g"), done, ["h", "g"], ["id"]).select("id", "n_links", "component_id")
    out = out.union(rows.where("h is null").select("id", F.lit(0).cast("long"), "id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op3(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors).withColumnRenamed("id", "vec_id")
