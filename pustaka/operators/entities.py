"""Persons and sources under several names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pustaka.functions import text as T


def tokens_within_one(names: DataFrame, persons: DataFrame, least: int = 3) -> DataFrame:
    """(name, person): names all of whose tokens of `least` letters or more belong to exactly one person; an exact match comes first.

    names: (name); persons: (person). Tokens are joined, counted per pair and compared with the name's own count.
    """
    tok = lambda df, c: df.select(c, F.explode(F.array_distinct(F.filter(F.split(T.name_key(F.col(c)), " "), lambda t: F.length(t) >= least))).alias("t"))
    n, p = tok(names.distinct(), "name"), tok(persons.distinct(), "person")
    size = n.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    full = n.join(p, "t").groupBy("name", "person").agg(F.count(F.lit(1)).alias("m")).join(size, "name").filter("m = n").select("name", "person")
    exact = names.distinct().join(persons.distinct(), T.name_key(F.col("name")) == T.name_key(F.col("person"))).groupBy("name").agg(F.min("person").alias("person"))
    single = full.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.min("person").alias("person")).filter("k = 1").select("name", "person")
    return exact.union(single.join(exact, "name", "left_anti"))


def collisions(new: DataFrame, known: DataFrame) -> DataFrame:
    """(new columns, outcome): new names against known ones. A name is `same` if a known one has its rank and year, `clash` if
    known ones have other ranks or years, `open` if they state neither, `new` if there is none."""
    k = known.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("air", "year"))).alias("seen"))
    j = new.join(k, "key", "left")
    same = F.exists("seen", lambda s: s["air"].eqNullSafe(F.col("air")) & s["year"].eqNullSafe(F.col("year")))
    stated = F.exists("seen", lambda s: s["air"].isNotNull() | s["year"].isNotNull())
    return j.select(*new.columns, F.when(F.col("seen").isNull(), "new").when(same, "same").when(stated, "clash").otherwise("open").alias("outcome"))


#: How publishers number their tests in an address, tried in this order; what is captured is the test. Fixed values.
TEST_NUMBERS = (r"/(\d{4}/\d{5})_", r"/link/(\d{6,})_", r"/ocr/(\d{6,})_", r"/compiled/([a-z0-9_]+)\.pdf")


def clusters(urls: DataFrame, patterns: tuple[str, ...] = TEST_NUMBERS[:1]) -> DataFrame:
    """(url, cluster): copies of one test by the numbers their publisher puts in the address, under the first pattern that fits; any other is a cluster of its own."""
    number = F.coalesce(*[F.nullif(F.regexp_extract("url", p, 1), F.lit("")) for p in patterns])
    return urls.select("url", F.when(number.isNotNull(), F.concat(T.url_host(F.col("url")), F.lit(":"), number)).otherwise(F.concat(F.lit("SINGLETON:"), F.substring(F.sha1("url"), 1, 12))).alias("cluster"))


def representatives(c: DataFrame) -> DataFrame:
    """(cluster, n, representative): the shortest URL of each cluster, then the first."""
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", F.struct(F.length("url"), "url")).alias("representative"))
