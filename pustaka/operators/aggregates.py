"""Aggregations of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_stated(value: str, order: str) -> Column:
    """The first value that is neither null nor blank, by an order."""
    stated = f"{value} IS NOT NULL AND trim(cast({value} AS string)) <> ''"
    return F.expr(f"min_by({value}, {order}) FILTER (WHERE {stated})")


def one_or_mixed(value: str) -> Column:
    """The only value of a group, or 'mixed'; null if it has none."""
    return F.when(F.min(value) != F.max(value), "mixed").otherwise(F.min(value))


def unanimous(value: str) -> Column:
    """The value all members that have one agree on, else null."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def copies(rows: DataFrame) -> DataFrame:
    """One row per copy: (base, topper, coaching, subject, paper, prov, n_rows, n_pages, first_page). Each text field is the first
    that is stated, in the order of the rows, each for itself."""
    return rows.filter("base <> ''").groupBy("base").agg(
        first_stated("topper", "ord").alias("topper"),
        first_stated("coaching", "ord").alias("coaching"),
        first_stated("subject", "ord").alias("subject"),
        F.min_by("paper", "ord").alias("paper"),
        one_or_mixed("prov").alias("prov"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("page").alias("n_pages"),
        F.min("page").alias("first_page"),
    )


def facets(df: DataFrame, by: list[str]) -> DataFrame:
    """(facet, value, n): counts by each column, in one pass over df."""
    sets = ", ".join(f"({c})" for c in by)
    label = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in by) + " END"
    out = df.sparkSession.sql(f"SELECT {label} AS facet, coalesce({', '.join(f'cast({c} AS string)' for c in by)}) AS value, count(*) AS n FROM {{df}} GROUP BY GROUPING SETS ({sets})", df=df)
    return out.filter("value IS NOT NULL")


def array_facet(df: DataFrame, array: Column, k: int) -> DataFrame:
    """(value, n): the k values most rows hold, ties by value; a value counts once a row."""
    return df.select(F.explode(F.array_distinct(array)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def low_yield(counts: DataFrame, group: str, n: str, floor: int = 8, share: float = 0.6) -> DataFrame:
    """Adds the median of n in a group, taken exactly from how often each count occurs, and whether n is below max(floor, share of it).

    The median needs one row per group and distinct count, so a group of very many members is reduced first.
    """
    freq = counts.groupBy(group, n).agg(F.count(F.lit(1)).alias("f"))
    by = Window.partitionBy(group).orderBy(n)
    run = freq.withColumn("upto", F.sum("f").over(by)).withColumn("all", F.sum("f").over(Window.partitionBy(group)))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    med = run.groupBy(group).agg(((F.min(F.when(F.col("upto") > low, F.col(n))) + F.min(F.when(F.col("upto") > high, F.col(n)))) / 2).alias("median"))
    return counts.join(med, group).withColumn("low", F.col(n) < F.greatest(F.lit(float(floor)), F.col("median") * share))
