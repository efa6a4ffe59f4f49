"""The corpus pipeline: documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality, simhash, toxicity
from tessera.llm.common import drop_tables, fresh, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    The model learns from docs themselves as far as labels has them. Null and empty texts score like a text without
    words, which a model of both classes keeps. Rows with equal or null ids are judged each on its own; columns come
    through as they are, whatever their names; no rows give no rows.
    """
    name = fresh(docs, "_score")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, name=name).where(F.col(name) < toxicity.TOXIC_AT).drop(name)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go.

    Null texts are judged like empty ones, by what the model makes of features that are all zero. Rows with equal or
    null ids are judged each on its own; columns come through as they are, whatever their names; no rows give no rows.
    """
    name = fresh(docs, "_score")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, name=name).where(F.col(name) >= quality.GOOD_AT).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, Jaccard index 0.8) stays: the one with the smallest doc_id.

    Null, empty and blank texts are one group. Of rows that repeat one stays; rows without an id stay if nothing else
    of their group has one. Columns come through as they are, whatever their names; no rows give no rows.
    """
    return simhash.dedup(docs, shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of tokens meets its target weight; a document has a row for each epoch it is in.

    Null languages and sources are leaves of their own; documents without tokens are in as often as their leaf, and
    a leaf without any tokens is left out. Rows that repeat count each; no rows give no rows.
    """
    name = fresh(docs, "_epoch")
    return mixing.mix_rows(docs, epoch=name).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, with their sequences.

    Null and empty texts are pieces of one token; rows that repeat are documents of their own; no rows give no rows.
    """
    return packing.op10(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Trained models, fingerprints and token ids cannot be expressed in SQL; tests/llm/test_pipeline.py holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's input is deleted when its output is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        found = materialize(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            drop_tables(spark, [docs])
        docs = found
    return docs
