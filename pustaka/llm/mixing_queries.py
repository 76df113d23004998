"""Queries of the mixing of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.llm.mixing import mix, share_report
from pustaka.llm.token_counts import token_counts
from pustaka.session import cut, read


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(token_counts(read(spark, sf_dir, "documents"), keep=("source",)), read(spark, sf_dir, "source_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_report(cut(p9_mixture(spark, sf_dir), "mixture"), read(spark, sf_dir, "source_targets"))


def p9_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its documents, and whether none is used too often and its tokens are its share of all, but for the rounding of a few documents."""
    m = cut(p9_mixture(spark, sf_dir), "mixture")
    large = m.groupBy("source").agg(F.max("n_tokens").alias("large"))
    total = m.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("total"))
    r = share_report(m, read(spark, sf_dir, "source_targets")).join(large, "source").crossJoin(F.broadcast(total))
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= F.lit(4.0) * F.col("large") / F.col("total") + 1e-6
    return r.select("source", "n_docs", (F.col("most_copies") <= F.col("max_repeats")).alias("few_enough"), near.alias("has_its_share"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_bounds": p9_bounds}
ORACLE = {"p9_bounds": "SELECT source, count(*) AS n_docs, true AS few_enough, true AS has_its_share FROM documents JOIN source_targets USING (source) GROUP BY 1"}
