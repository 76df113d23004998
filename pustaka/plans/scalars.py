"""Queries of the scalar functions over whole texts, names and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.functions import text as T
from pustaka.plans import sql as S
from pustaka.session import read


def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "submissions").select("submission_id", T.norm(F.col("question")).alias("norm"))


def q_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "submissions").select("submission_id", T.q_key(F.col("question")).alias("qkey"))


def meta_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    return read(spark, sf_dir, "submissions").select("submission_id", T.meta_marks(m).alias("marks"), T.meta_words(m).alias("words"), T.display(F.col("question")).alias("shown"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "submissions").select("submission_id", T.url_base(u).alias("base"), T.url_fragment(u).alias("fragment"), T.url_host(u).alias("host"), T.file_air(u).alias("air"), T.file_rank(u).alias("rank"))


def fnv32_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.fnv32(F.col("question"))
    return read(spark, sf_dir, "submissions").select("submission_id", h.alias("fnv32")).withColumn("part", F.col("fnv32") % 8)


def copy_id48(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "submissions").select(T.url_base(F.col("url")).alias("base")).filter("base <> ''").distinct()
    return b.select("base", T.copy_id(F.col("base")).alias("copy_id"))


def copy_id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = copy_id48(spark, sf_dir)
    clash = ids.groupBy("copy_id").agg(F.count_distinct("base").alias("n"))
    return clash.agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("n") > 1).alias("n_collisions"))


def lead_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over 500 characters cut at the last space within the first 250, if it lies beyond 150, else at 250."""
    d = read(spark, sf_dir, "documents").filter(F.length("text") > 500)
    head = F.substring("text", 1, 251)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (at >= 150), at).otherwise(250)
    return d.select("doc_id", cut.cast("long").alias("cut"), "text").select(
        "doc_id", "cut", F.substring(F.col("text"), F.lit(1), F.col("cut").cast("int")).alias("lead"), F.length(F.substring(F.col("text"), F.col("cut").cast("int") + 1, F.length("text"))).cast("long").alias("tail_length")
    )


def grouped_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per supplier written with Indian digit groups, and floored to a step of 50."""
    n = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).cast("long").alias("n"))
    digits = F.col("n").cast("string")
    head, tail = F.substring(digits, F.lit(1), F.length(digits) - 3), F.right(digits, F.lit(3))
    groups = F.reverse(F.regexp_replace(F.reverse(head), r"(\d\d)(?=\d)", "$1,"))
    return n.select("l_suppkey", "n", F.when(F.length(digits) > 3, F.concat(groups, F.lit(","), tail)).otherwise(digits).alias("shown"), (F.floor(F.col("n") / 50) * 50).alias("floored"))


QUERIES = {f.__name__: f for f in (norm_key, q_key, meta_parts, url_parts, fnv32_part, copy_id48, copy_id_collisions, lead_and_tail, grouped_number)}

_IDS = rf"""b AS (SELECT DISTINCT {S.base("url")} AS base FROM submissions WHERE {S.base("url")} <> ''),
h AS (SELECT base, ({S.fnv32("base")}) * 65536 + (({S.djb32("base")}) >> 16) AS v FROM b),
d AS (SELECT base, list_transform(range(0, 10), lambda i: ((v::HUGEINT // (36::HUGEINT ** i)::HUGEINT) % 36)::INT) AS d FROM h),
i AS (SELECT base, ltrim(list_aggregate(list_reverse(list_transform(d, lambda x: substr('0123456789abcdefghijklmnopqrstuvwxyz', x + 1, 1))), 'string_agg', ''), '0') AS copy_id FROM d)"""

ORACLE = {
    "norm_key": f"SELECT submission_id, {S.norm('question')} AS norm FROM submissions",
    "q_key": f"SELECT submission_id, {S.q_key('question')} AS qkey FROM submissions",
    "meta_parts": rf"""SELECT submission_id, {S.meta("metadata", "marks")} AS marks, {S.meta("metadata", "words")} AS words,
  regexp_replace(coalesce(question, ''), '^\s*(?:Q(?:uestion)?\.?\s*)?\d{{1,3}}[.):\-]?\s+', '', 'i') AS shown FROM submissions""",
    "url_parts": rf"""WITH u AS (SELECT submission_id, {S.base("url")} AS base, CASE WHEN contains(url, '#') THEN regexp_replace(trim(url), '^[^#]*#', '') ELSE '' END AS fragment, {S.host("url")} AS host FROM submissions)
SELECT *, try_cast(regexp_extract(split_part(base, '/', -1), '(?i)AIR[-_ ]?(\d{{1,3}})(?:\D|$)', 1) AS INT) AS air,
  try_cast(regexp_extract(split_part(base, '/', -1), '(?i)(?:^|[-_ .])rank[-_ ]?(\d{{1,3}})(?:\D|$)', 1) AS INT) AS rank FROM u""",
    "fnv32_part": f"WITH h AS (SELECT submission_id, {S.fnv32('question')} AS fnv32 FROM submissions) SELECT *, fnv32 % 8 AS part FROM h",
    "copy_id48": f"WITH {_IDS} SELECT base, copy_id FROM i",
    "copy_id_collisions": f"WITH {_IDS}, g AS (SELECT copy_id, count(DISTINCT base) AS n FROM i GROUP BY copy_id) SELECT count(*) AS n_ids, count(*) FILTER (n > 1) AS n_collisions FROM g",
    "lead_and_tail": """WITH d AS (SELECT doc_id, text, substr(text, 1, 251) AS head FROM documents WHERE length(text) > 500),
p AS (SELECT doc_id, text, CASE WHEN contains(head, ' ') AND length(head) - instr(reverse(head), ' ') >= 150 THEN length(head) - instr(reverse(head), ' ') ELSE 250 END AS cut FROM d)
SELECT doc_id, cut::BIGINT AS cut, substr(text, 1, cut) AS lead, length(substr(text, cut + 1))::BIGINT AS tail_length FROM p""",
    "grouped_number": r"""WITH n AS (SELECT l_suppkey, floor(sum(l_extendedprice::DECIMAL(18, 2)))::BIGINT AS n FROM lineitem GROUP BY 1), s AS (SELECT *, n::VARCHAR AS d FROM n)
SELECT l_suppkey, n, CASE WHEN length(d) > 3 THEN regexp_replace(reverse(regexp_replace(reverse(d[:-4]), '(\d\d)', '\1,', 'g')), '^,', '') || ',' || right(d, 3) ELSE d END AS shown, n // 50 * 50 AS floored FROM s""",
}
