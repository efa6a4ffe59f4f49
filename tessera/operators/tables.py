"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on one machine (tests) a new one where it is unset, on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/engine/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table that is read again, so that lost executors and later steps repeat nothing before it.

    Given columns, the table is laid out in folders by them.
    """
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop(*frames: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            top, name = file.split("/engine/", 1)
            remove(df.sparkSession, f"{top}/engine/{name.split('/', 1)[0]}")
