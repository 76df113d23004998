"""Checks that a corpus holds together, and how far copies of one thing agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def invariant(name: str, df: DataFrame, bad: Column) -> DataFrame:
    """(id, ok, bad_count): how many rows break a rule."""
    return df.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("bad_count")).select(F.lit(name).alias("id"), (F.col("bad_count") == 0).alias("ok"), "bad_count")


def all_of(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, checks)


def overlap_with_first(members: DataFrame, group: str, copy: str, key: str) -> DataFrame:
    """(group, copy, n, common, overlap): each copy's keys against those of the first copy of its group, as a share of the smaller set."""
    k = members.select(group, copy, key).distinct()
    first = k.groupBy(group).agg(F.min(copy).alias("first"))
    size = k.groupBy(group, copy).agg(F.count(F.lit(1)).alias("n"))
    base = k.join(first, group).filter(F.col(copy) == F.col("first")).select(group, key)
    common = k.join(base, [group, key]).groupBy(group, copy).agg(F.count(F.lit(1)).alias("common"))
    base_size = base.groupBy(group).agg(F.count(F.lit(1)).alias("n_first"))
    j = size.join(first, group).filter(F.col(copy) != F.col("first")).join(common, [group, copy], "left").join(base_size, group)
    c = F.coalesce("common", F.lit(0))
    return j.select(group, copy, "n", c.alias("common"), (c / F.least("n", "n_first")).alias("overlap"))
