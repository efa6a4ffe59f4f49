"""Tables laid out in folders by a hash of the key, changed a few folders at a time.

A change reads and rewrites the buckets that its keys fall into and no others, so it costs what it is worth and not
what the table is. Every change may be repeated: it finds its own result and makes it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import lifecycle, tables

BUCKET = "_bucket"


def bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def create(rows: DataFrame, path: str, key: str, n: int) -> None:
    """Writes rows as a table of n buckets, in place of what is there. Rows without a key are in one bucket."""
    rows.withColumn(BUCKET, bucket(key, n)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table's rows; none where nothing was written yet."""
    if not tables.exists(spark, path):
        return spark.createDataFrame([], schema)
    return _whole(spark, path, schema).drop(BUCKET)


def _whole(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)


def touched(rows: DataFrame, key: str, n: int) -> list[int]:
    """The buckets of rows' keys: n numbers at most."""
    return sorted(r[0] for r in rows.select(bucket(key, n).alias("b")).distinct().collect())


def part(spark: SparkSession, path: str, schema: T.StructType, which: list[int]) -> DataFrame:
    """The rows of some buckets; the others' files are not opened."""
    if not tables.exists(spark, path):
        return spark.createDataFrame([], schema)
    return _whole(spark, path, schema).where(F.col(BUCKET).isin(which)).drop(BUCKET)


def rewrite(rows: DataFrame, path: str, key: str, n: int, which: list[int]) -> None:
    """Puts rows in place of all that the buckets named hold. Rows are written before anything of the table is."""
    spark = rows.sparkSession
    held = tables.written(rows.withColumn(BUCKET, bucket(key, n)), "buckets")
    held.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for empty in set(which) - {r[0] for r in held.select(BUCKET).distinct().collect()}:
        tables.remove(spark, f"{path}/{BUCKET}={empty}")
    tables.drop(held)


def upsert(path: str, new: DataFrame, key: str, n: int, newest: str | None = None, gone: DataFrame | None = None) -> list[int]:
    """One row per key: new rows replace those of their keys (the latest by `newest` of several), keys of gone go. Returns the buckets changed."""
    spark = new.sparkSession
    new = new.where(F.col(key).isNotNull())
    keys = new.select(key) if gone is None else new.select(key).union(gone.select(F.col(key).cast(dict(new.dtypes)[key])))
    which = touched(keys, key, n)
    if which:
        old = part(spark, path, new.schema, which)
        out = lifecycle.upsert(old, new, [key], newest) if newest else old.join(new.select(key), key, "left_anti").select(new.columns).unionByName(new.dropDuplicates([key]))
        rewrite(out if gone is None else out.join(gone.select(key), key, "left_anti").select(new.columns), path, key, n, which)
    return which


def replace_owners(path: str, new: DataFrame, owner: str, n: int) -> list[int]:
    """Every owner in new has new's rows and no others; the table is in buckets by owner. Returns the buckets changed."""
    which = touched(new, owner, n)
    if which:
        old = part(new.sparkSession, path, new.schema, which)
        rewrite(lifecycle.replace_partition(old, new, owner).select(new.columns), path, owner, n, which)
    return which
