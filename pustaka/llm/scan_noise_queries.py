"""Queries of the repair of scanned text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pustaka.llm.scan_noise import noise, repaired
from pustaka.session import read


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(read(spark, sf_dir, "ocr_questions"))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(read(spark, sf_dir, "ocr_questions"))


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
ORACLE: dict[str, str] = {}
