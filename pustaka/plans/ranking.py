"""Queries of orders, places and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pustaka.functions import text as T
from pustaka.operators import aggregates as A
from pustaka.operators import ranking as R
from pustaka.plans import sql as S
from pustaka.plans.aggregates import _COPIES
from pustaka.session import read
from pustaka.sources.corpus import rows_sql, source_rows


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight sample questions of each person: the longest, then by row."""
    r = source_rows(spark, sf_dir).withColumn("key", T.name_key(F.col("topper"))).filter("key <> '' AND question IS NOT NULL").withColumn("size", F.length("question"))
    return R.top_k(r.select("key", "ord", "size"), ["key"], [F.desc("size"), F.col("ord")], 8).select("key", "ord", "place")


def page_chunks_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "submissions").select(T.name_key(F.col("topper")).alias("key")).filter("key <> ''").distinct()
    return R.pages(names, ["key"], "key", 200)


def round_robin_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lc = read(spark, sf_dir, "link_copies").select("copy_id", T.url_host(F.col("url")).alias("host"))
    return R.round_robin(lc, "host", "copy_id").select("copy_id", "host", "turn", "slot")


def capacity_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    k = R.within_capacity(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "q"], "q", 2000)
    return k.groupBy("l_suppkey").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_pending"), F.max(F.when(F.col("kept"), F.col("running"))).cast("double").alias("used"))


def canonical_variant_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling that stands for each name key, over three lists: mixed case first, then more capitalised words, then the most frequent, then the first."""
    n = read(spark, sf_dir, "submissions").select("topper").union(read(spark, sf_dir, "toppers").select("topper")).union(read(spark, sf_dir, "link_copies").select("topper"))
    n = n.filter("topper IS NOT NULL").groupBy("topper").agg(F.count(F.lit(1)).alias("n")).withColumn("key", T.name_key(F.col("topper"))).filter("key <> ''")
    shouty = (~(F.col("topper").rlike("[a-z]") & F.col("topper").rlike("[A-Z]"))).cast("int")
    caps = F.size(F.filter(F.split("topper", r"\s+"), lambda w: w.rlike("^[A-Z]")))
    return R.top_k(n.withColumn("shouty", shouty).withColumn("caps", caps), ["key"], [F.col("shouty"), F.desc("caps"), F.desc("n"), F.col("topper")], 1).select("key", "topper", "n")


def slug_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "submissions").filter("topper IS NOT NULL").groupBy("topper").agg(F.min("submission_id").alias("ord"))
    return R.unique_slugs(names.withColumn("slug", T.slug(F.col("topper"))), "slug", "ord").select("topper", "unique_slug")


def browse_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two pages of 25 copies: newest year first and unknown last, then rank, then name and paper."""
    c = A.copies(source_rows(spark, sf_dir)).filter("topper IS NOT NULL").withColumn("key", T.name_key(F.col("topper")))
    p = read(spark, sf_dir, "toppers").withColumn("key", T.name_key(F.col("topper"))).filter("key <> ''").groupBy("key").agg(A.first_stated("air", "rec_id").alias("air"), A.first_stated("year", "rec_id").alias("year"))
    j = c.join(p, "key", "left").select("base", "topper", "paper", "n_rows", F.coalesce("year", F.lit(0)).alias("year"), F.coalesce(F.nullif("air", F.lit(0)), F.lit(1_000_000_000)).alias("rank"))
    return j.orderBy(F.desc("year"), "rank", "topper", "paper", "base").limit(50)


def question_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different question with its number in the order of its text, and the gap to the one before in its paper."""
    q = source_rows(spark, sf_dir).select("paper", T.norm(F.col("question")).alias("norm")).filter("norm <> ''").distinct()
    return R.places(q, ["norm", "paper"], "qid").withColumn("gap", F.col("qid") - F.coalesce(F.lag("qid").over(Window.partitionBy("paper").orderBy("qid")), F.lit(0)))


QUERIES = {f.__name__: f for f in (topk_per_group, page_chunks_200, round_robin_hosts, capacity_running_sum, canonical_variant_pick, slug_suffix, browse_ranked, question_numbers)}

ORACLE = {
    "topk_per_group": f"""WITH k AS (SELECT {S.name_key("topper")} AS key, submission_id AS ord, length(question) AS size FROM submissions WHERE question IS NOT NULL AND {S.name_key("topper")} <> ''),
r AS (SELECT key, ord, row_number() OVER (PARTITION BY key ORDER BY size DESC, ord) AS place FROM k) SELECT * FROM r WHERE place <= 8""",
    "page_chunks_200": f"""WITH n AS (SELECT DISTINCT {S.name_key("topper")} AS key FROM submissions WHERE {S.name_key("topper")} <> ''), p AS (SELECT key, row_number() OVER (ORDER BY key) AS place FROM n)
SELECT (place - 1) // 200 + 1 AS page_no, arg_min(key, place) AS first_label, arg_max(key, place) AS last_label, count(*) AS n FROM p GROUP BY 1""",
    "round_robin_hosts": f"""WITH l AS (SELECT copy_id, {S.host("url")} AS host FROM link_copies), t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY copy_id) AS turn, min(copy_id) OVER (PARTITION BY host) AS seen FROM l)
SELECT copy_id, host, turn, row_number() OVER (ORDER BY turn, seen) AS slot FROM t""",
    "capacity_running_sum": """WITH r AS (SELECT l_suppkey, sum(l_quantity::DECIMAL(18, 2)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS running FROM lineitem)
SELECT l_suppkey, count(*) FILTER (running <= 2000) AS n_kept, count(*) FILTER (running > 2000) AS n_pending, max(running) FILTER (running <= 2000)::DOUBLE AS used FROM r GROUP BY 1""",
    "canonical_variant_pick": rf"""WITH a AS (SELECT topper FROM submissions UNION ALL SELECT topper FROM toppers UNION ALL SELECT topper FROM link_copies),
n AS (SELECT topper, count(*) AS n, {S.name_key("topper")} AS key FROM a WHERE topper IS NOT NULL GROUP BY topper),
r AS (SELECT key, topper, n, row_number() OVER (PARTITION BY key ORDER BY NOT (regexp_matches(topper, '[a-z]') AND regexp_matches(topper, '[A-Z]')), len(list_filter(regexp_split_to_array(topper, '\s+'), lambda w: regexp_matches(w, '^[A-Z]'))) DESC, n DESC, topper) AS k FROM n WHERE key <> '')
SELECT key, topper, n FROM r WHERE k = 1""",
    "slug_suffix": rf"""WITH RECURSIVE n AS (SELECT topper, min(submission_id) AS ord, {S.slug("topper")} AS slug FROM submissions WHERE topper IS NOT NULL GROUP BY topper),
r AS (SELECT *, regexp_replace(slug, '(?:-\d+)+$', '') AS stem, row_number() OVER (PARTITION BY regexp_replace(slug, '(?:-\d+)+$', '') ORDER BY ord) AS k FROM n),
f AS (SELECT stem, k, topper, slug AS made, [slug] AS taken FROM r WHERE k = 1 UNION ALL
  SELECT stem, k, topper, m, list_append(taken, m) FROM (SELECT r.stem, r.k, r.topper, f.taken, list_filter(list_transform(range(1, len(f.taken) + 2), lambda i: CASE WHEN i = 1 THEN r.slug ELSE r.slug || '-' || i END), lambda x: NOT list_contains(f.taken, x))[1] AS m
    FROM f JOIN r ON r.stem = f.stem AND r.k = f.k + 1))
SELECT topper, made AS unique_slug FROM f""",
    "browse_ranked": _COPIES
    + f""", p AS (SELECT {S.name_key("topper")} AS key, arg_min(air, rec_id) FILTER (air IS NOT NULL) AS air, arg_min(year, rec_id) FILTER (year IS NOT NULL) AS year FROM toppers WHERE {S.name_key("topper")} <> '' GROUP BY 1)
SELECT base, topper, paper, n_rows, coalesce(year, 0) AS year, coalesce(nullif(air, 0), 1000000000) AS rank FROM copies LEFT JOIN p ON {S.name_key("copies.topper")} = p.key WHERE topper IS NOT NULL ORDER BY 5 DESC, 6, 2, 3, 1 LIMIT 50""",
    "question_numbers": "WITH "
    + rows_sql()
    + f""", q AS (SELECT DISTINCT paper, {S.norm("question")} AS norm FROM src WHERE {S.norm("question")} <> ''), p AS (SELECT *, row_number() OVER (ORDER BY norm, paper) AS qid FROM q)
SELECT *, qid - coalesce(lag(qid) OVER (PARTITION BY paper ORDER BY qid), 0) AS gap FROM p""",
}
