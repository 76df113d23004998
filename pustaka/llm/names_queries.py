"""Queries of the linking of name variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pustaka.llm.names import name_pairs, persons
from pustaka.session import read


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(read(spark, sf_dir, "submissions")).toDF("topper_a", "topper_b")


def p5_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persons(read(spark, sf_dir, "submissions")).toDF("topper", "person", "n_rows")


QUERIES = {"p5_found": p5_found, "p5_persons": p5_persons}
ORACLE: dict[str, str] = {}
