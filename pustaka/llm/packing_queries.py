"""Queries of the packing of documents into containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.llm.packing import evolution_report, fill_report, pack
from pustaka.llm.token_counts import token_counts
from pustaka.session import cut, read


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(read(spark, sf_dir, "documents")), read(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(cut(p8_packed(spark, sf_dir), "packed"), read(spark, sf_dir, "pack_sizes"))


def p8_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolution_report(token_counts(read(spark, sf_dir, "documents")), read(spark, sf_dir, "pack_sizes"))


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity the documents that are placed, how many are parted though they fit, and how many containers hold too much."""
    packed = cut(p8_packed(spark, sf_dir), "packed").join(read(spark, sf_dir, "pack_sizes"), "pack_name")
    docs = packed.groupBy("pack_name", "capacity_tokens", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n")).groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("parts") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("n_parted"))
    full = packed.groupBy("pack_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("pack_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_too_full"))
    return docs.join(full, "pack_name")


QUERIES = {"p8_placed": p8_placed, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_evolution": p8_evolution}
ORACLE = {"p8_placed": "SELECT pack_name, count(DISTINCT doc_id) AS n_docs, 0 AS n_parted, 0 AS n_too_full FROM documents, pack_sizes GROUP BY 1"}
