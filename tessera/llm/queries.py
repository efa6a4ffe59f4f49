"""The registered queries of this subpackage and their SQL. Each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import centroids, chat, embedding_dedup, html_extract, mixing, packing, quality, runs, sharding, simhash, topk, toxicity, url_filter
from tessera.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op1(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.op3(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op5(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op7(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op8(table(spark, sf_dir, "pages"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op9(table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op10(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.op11(table(spark, sf_dir, "documents"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op12(table(spark, sf_dir, "conversations"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.op13(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_simhash_near_dedup,
        op2_mixing,
        op3_embedding_near_dedup,
        op4_toxicity,
        op5_exact_top_k,
        op6_quality,
        op7_sharding,
        op8_html_extraction,
        op9_url_filters,
        op10_best_fit_packing,
        op11_periodic_runs,
        op12_chat_formatting,
        op13_centroid_clustering,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.op2_sql(), "op5_exact_top_k": topk.OP5_SQL, "op12_chat_formatting": chat.op12_sql(), "op13_centroid_clustering": centroids.op13_sql()}
