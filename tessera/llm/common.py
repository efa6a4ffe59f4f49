"""Shared pieces: tables in the cluster's shared folder, salted ranks and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a session on one machine (tests) gets a new folder; on a cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    This cuts lineage (a lost executor costs no recomputation of what is before), keeps an expensive Python
    step from running once per branch, and gives the optimiser true sizes, so it broadcasts what is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, frames: list[DataFrame]) -> None:
    """Deletes materialised tables that nothing reads any more."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    done = set()
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/tessera/" in file and folder.toString() not in done:
                done.add(folder.toString())
                folder.getFileSystem(conf).delete(folder, True)


def ranked(df: DataFrame, key: list[str], order: list[str], rank: str, salts: int = 256, tie: str | None = None) -> DataFrame:
    """Adds a gapless rank from 0 within each key, without bringing a key's rows together.

    Rows are dealt by (key, salt), the salt being a hash of what they are ordered by and, given a column that tells
    all rows of a written table apart, of that: so rows alike in everything else are dealt, too. Each salt's rank
    starts where the salts before it end. The table of (key, salt) counts has at most keys x salts rows, whatever
    the size of a key.
    """
    order = [*order, *([tie] if tie else [])]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*key, "_salt").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(inside) - 1)
    on = [numbered[k].eqNullSafe(starts[k]) for k in key] + [numbered["_salt"] == starts["_salt"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    keep = [numbered[c] for c in df.columns]
    return numbered.join(starts, cond).select(*keep, (F.col("_start") + F.col("_row")).cast("long").alias(rank))


def salted(rows: DataFrame, table: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined with table (one row per key): a key's rows are dealt into so many parts by a column of theirs."""
    parts = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(parts, [*on, "_salt"], how).drop("_salt")


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], how: str = "inner", share: int = 2048) -> DataFrame:
    """rows joined with table (one row per key) where one key may hold many of the rows. Hot keys are told by the first column of on.

    A key with more than a 2048th of all rows has its rows dealt into parts by other columns of theirs; there can be
    at most that many such keys, so their list is small whatever the table's size.
    """
    first = on[0]
    counts = rows.where(F.col(first).isNotNull()).groupBy(first).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    heavy = materialize(counts.where(F.col("_n") > max(total // share, 8)).select(F.col(first).alias("_heavy")), "heavy")
    few = F.broadcast(heavy)  # at most `share` keys
    dealt = rows.join(few, F.col(first) == F.col("_heavy"), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_heavy").isNotNull(), F.pmod(F.xxhash64(*by), F.lit(256))).otherwise(0).cast("int")).drop("_heavy")
    parts = table.join(few, F.col(first) == F.col("_heavy"), "left")
    parts = parts.withColumn("_salt", F.explode(F.when(F.col("_heavy").isNotNull(), F.sequence(F.lit(0), F.lit(255))).otherwise(F.array(F.lit(0))))).drop("_heavy")
    return dealt.join(parts, [*on, "_salt"], how).drop("_salt")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node of each connected component, from edges (u, v) of longs.

    Alternates large-star and small-star: minima are partial aggregates, so a hub is summed up where its
    edges lie, and the joins that follow may be split by key. Rounds grow with the logarithm of a chain's
    length. Nodes without edges do not appear. Each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    cur = materialize(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(cur)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join below reads two tables and may split a hub's edges
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(mins, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = materialize(small, "edges")
        new = _state(nxt)
        drop_tables(spark, [cur, least, large])
        cur, same, state = nxt, new == state, new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    inner = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return inner.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def least_names(classes: DataFrame, node: str, first: str, edges: DataFrame) -> DataFrame:
    """(node, component, name) for each node with edges (u, v): the least `first` of its component, null if none has any."""
    found = materialize(components(edges), "components")
    names = found.join(classes.select(F.col(node).alias("node"), first), "node").groupBy("component").agg(F.min(first).alias("name"))
    return spread_join(found, names, ["component"], ["node"]).select("node", "component", "name")
