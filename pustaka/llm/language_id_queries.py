"""Queries of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.llm.language_id import language_segments, relabelled, train
from pustaka.llm.scan_noise import plain_text
from pustaka.session import cut, read


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "ocr_questions")
    model = train(rows, read(spark, sf_dir, "ocr_labels"))
    return rows, cut(language_segments(plain_text(rows), model), "segments")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, segs = _segments(spark, sf_dir)
    return relabelled(segs, rows).select("ocr_id", "seg_no", "lang")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, segs = _segments(spark, sf_dir)
    return segs.withColumn("confidence", F.round("confidence", 4))


QUERIES = {"p3_found": p3_found, "p3_segments": p3_segments}
ORACLE: dict[str, str] = {}
