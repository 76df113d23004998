"""Queries of the encoding repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.llm.encoding_repair import garbled, restored_text
from pustaka.session import read


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(read(spark, sf_dir, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(read(spark, sf_dir, "documents"))


def p10_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beyond ASCII garbled once more, and whether its repair gives what the repair of the document itself gives."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text").filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    planted = d.select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    fix = lambda df: df.join(garbled(df).select("doc_id", "restored"), "doc_id", "left").select("doc_id", restored_text(F.col("restored"), F.col("text")).alias("text"))
    return fix(planted).withColumnRenamed("text", "again").join(fix(d), "doc_id").select("doc_id", F.coalesce(F.col("again") == F.col("text"), F.lit(False)).alias("same"))


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored, "p10_planted": p10_planted}
ORACLE = {"p10_planted": r"SELECT doc_id, true AS same FROM documents WHERE regexp_matches(text, '[^\x00-\x7f]')"}
