"""Micro-batches that write several tables as one.

Each table takes a batch in a folder of its own, and a marker is written last. Readers take marked batches only, so
of a batch that failed between two tables nothing is seen, and its repetition overwrites what there is of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import tables

DONE = "_done"


def write(frames: dict[str, DataFrame], path: str, batch: int) -> None:
    """Writes one batch of every table, then its marker. A batch that is marked stays as it is."""
    spark = next(iter(frames.values())).sparkSession
    marker = f"{path}/{DONE}/batch={batch}"
    if tables.exists(spark, marker):
        return
    for name, rows in frames.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    spark.range(1).select(F.lit(batch).cast("long").alias("marked")).coalesce(1).write.parquet(f"{path}/{DONE}/_new-{batch}", mode="overwrite")
    folder = spark._jvm.org.apache.hadoop.fs.Path
    store = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.rename(folder(f"{path}/{DONE}/_new-{batch}"), folder(marker)):  # one step: a marker is there whole or not at all
        raise OSError(f"cannot write {marker}")


def read(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """A table's rows of marked batches, with `batch`; none before the first. Folders of other batches are not opened."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if not tables.exists(spark, f"{path}/{DONE}") or not tables.exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], whole)
    done = spark.read.schema("marked long").parquet(f"{path}/{DONE}").select(F.col("marked").alias("batch"))
    return spark.read.schema(whole).parquet(f"{path}/{name}").join(F.broadcast(done), "batch", "left_semi").select(*schema.names, "batch")  # a row a batch


def run_available(stream: DataFrame, split: Callable[[DataFrame], dict[str, DataFrame]], path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there of a stream: each micro-batch becomes the tables that split makes of it."""

    def each(rows: DataFrame, batch: int) -> None:
        held = tables.written(rows, "batch")  # once, however many tables there are
        write(split(held), path, batch)
        tables.drop(held)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
