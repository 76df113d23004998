"""The question corpus: source rows with a total order, the copies they belong to, and the persons who wrote them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.functions import text as T
from pustaka.session import read


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """submissions with the keys the operators use. Their order is that of submission_id, on which every `first` rests."""
    s = read(spark, sf_dir, "submissions")
    return s.select(
        F.col("submission_id").alias("ord"),
        "topper",
        "coaching",
        "subject",
        T.paper_of(F.col("subject")).alias("paper"),
        F.nullif(F.regexp_extract(T.blank(F.col("page_number")), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)).alias("page"),
        "question",
        T.meta_marks(F.col("metadata")).alias("marks"),
        T.meta_words(F.col("metadata")).alias("words"),
        T.url_base(F.col("url")).alias("base"),
        "prov",
    )


def rows_sql() -> str:
    """source_rows() for DuckDB."""
    from pustaka.plans import sql as S

    return rf"""src AS (SELECT submission_id AS ord, topper, coaching, subject, {S.paper("subject")} AS paper,
  nullif(try_cast(regexp_extract(coalesce(page_number, ''), '^\s*([+-]?\d+)', 1) AS INT), 0) AS page, question,
  {S.meta("metadata", "marks")} AS marks, {S.meta("metadata", "words")} AS words, {S.base("url")} AS base, prov FROM submissions)"""
