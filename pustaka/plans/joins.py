"""Queries of the join shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pustaka.functions import text as T
from pustaka.operators.joins import in_ranges, merged, paired, pairs_by_place, rewrite, without
from pustaka.plans import sql as S
from pustaka.session import read
from pustaka.sources.corpus import source_rows


def denylist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose question key is not that of a salvaged question, and whose copy is not listed as a link."""
    keys = read(spark, sf_dir, "ocr_questions").filter("salvaged").select(T.q_key(F.col("question")).alias("qkey"))
    urls = read(spark, sf_dir, "link_copies").select(T.url_base(F.col("url")).alias("base"))
    rows = source_rows(spark, sf_dir).withColumn("qkey", T.q_key(F.col("question")))
    return without(without(rows, keys, ["qkey"]), urls, ["base"]).select("ord", "qkey", "base")


def url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies whose file has no rank in its name have moved to an address by id; the fragment stays."""
    s = read(spark, sf_dir, "submissions").select("submission_id", "url", T.url_base(F.col("url")).alias("base"))
    moves = s.filter(F.col("base").endswith("_copy.pdf")).select(F.col("base").alias("old"), F.concat(F.lit("https://moved.example/"), T.slug(F.col("base"))).alias("new")).distinct()
    frag = T.url_fragment(F.col("url"))
    tail = F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise("")
    return rewrite(s, F.col("base"), moves).select("submission_id", F.concat(F.coalesce("moved", "base"), tail).alias("url"), F.col("moved").isNotNull().alias("is_moved"))


def override_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of the link list merged with the lists of toppers, which count first; air and year each for itself."""
    lc = read(spark, sf_dir, "link_copies").withColumn("key", T.name_key(F.col("topper"))).filter("key <> ''")
    left = lc.groupBy("key").agg(F.expr("min_by(air, copy_id) FILTER (WHERE air IS NOT NULL)").alias("air"), F.expr("min_by(year, copy_id) FILTER (WHERE year IS NOT NULL)").alias("year"))
    tp = read(spark, sf_dir, "toppers").withColumn("key", T.name_key(F.col("topper"))).filter("key <> ''")
    right = tp.groupBy("key").agg(F.expr("min_by(air, rec_id) FILTER (WHERE air IS NOT NULL)").alias("air"), F.expr("min_by(year, rec_id) FILTER (WHERE year IS NOT NULL)").alias("year"))
    return merged(left, right, "key", ["air", "year"])


def range_part_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part a question's number lies in, where the parts are the papers in order and a part starts after those before it."""
    q = source_rows(spark, sf_dir).groupBy("paper").agg(F.count(F.lit(1)).alias("n"))
    order = F.expr("sum(n) OVER (ORDER BY paper ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    starts = q.withColumn("start", F.coalesce(order, F.lit(0)) + 1).select("start", F.col("paper").alias("part"))
    return in_ranges(read(spark, sf_dir, "submissions").select("submission_id"), "submission_id", starts, "start", "part")


def link_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link with the reason it is taken or not: it lacks a field, its copy is searchable already, or it is a repeat."""
    lc = read(spark, sf_dir, "link_copies").withColumn("base", T.url_base(F.col("url")))
    known = source_rows(spark, sf_dir).filter("base <> ''").select("base").distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("base").orderBy("copy_id"))
    j = lc.withColumn("k", first).join(known, "base", "left")
    lacks = (F.col("base") == "") | F.coalesce(F.trim("topper"), F.lit("")).isin("", "Unknown") | (F.coalesce(F.trim("paper"), F.lit("")) == "")
    return j.select("copy_id", F.when(lacks, "lacks a field").when(F.col("known"), "searchable").when(F.col("k") > 1, "repeat").otherwise("taken").alias("reason"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = source_rows(spark, sf_dir).filter("base <> ''").select(T.name_key(F.col("topper")).alias("person"), F.col("base").alias("old_url")).filter("person <> ''").distinct()
    new = read(spark, sf_dir, "link_copies").select(T.name_key(F.col("topper")).alias("person"), T.url_base(F.col("url")).alias("new_url")).filter("person <> '' AND new_url <> ''").distinct()
    return old, new


def positional_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    return paired(old, new, ["person"], ["old_url"], ["new_url"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_persons"), F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))


def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    return pairs_by_place(old, new, ["person"], "old_url", "new_url")


def missing_extra_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons that only one of the two lists has."""
    k = lambda t: read(spark, sf_dir, t).select(T.name_key(F.col("topper")).alias("key")).filter("key <> ''").distinct()
    a, b = k("submissions"), k("toppers")
    return a.join(b, "key", "left_anti").select("key", F.lit("missing").alias("side")).union(b.join(a, "key", "left_anti").select("key", F.lit("extra").alias("side")))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links kept unless a searchable copy replaces them, then the searchable copies: (base, origin, paper)."""
    fresh = source_rows(spark, sf_dir).filter("base <> ''").groupBy("base").agg(F.min_by("paper", "ord").alias("paper"))
    prev = read(spark, sf_dir, "link_copies").withColumn("base", T.url_base(F.col("url"))).filter("base <> ''").groupBy("base").agg(F.min_by(T.paper_of(F.col("paper")), "copy_id").alias("paper"))
    return fresh.select("base", F.lit("fresh").alias("origin"), "paper").union(prev.join(fresh, "base", "left_anti").select("base", F.lit("kept").alias("origin"), "paper"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of union, intersection and difference of the persons of the three lists."""
    k = lambda t: read(spark, sf_dir, t).select(T.name_key(F.col("topper")).alias("key")).filter("key <> ''").distinct()
    a, b, c = k("submissions"), k("toppers"), k("link_copies")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return n(a.union(b).union(c).distinct(), "union").union(n(a.intersect(b), "intersect")).union(n(a.exceptAll(b), "except")).union(n(a.union(b).union(c), "union all"))


QUERIES = {f.__name__: f for f in (denylist_anti, url_rewrite, override_full_outer, range_part_lookup, link_admission, positional_pairing, positional_pairs, missing_extra_keys, upsert_merge, set_operations)}

_K = lambda t: f"(SELECT DISTINCT {S.name_key('topper')} AS key FROM {t} WHERE {S.name_key('topper')} <> '')"
_SIDES = f"""o AS (SELECT DISTINCT {S.name_key("topper")} AS person, {S.base("url")} AS old_url FROM submissions WHERE {S.base("url")} <> '' AND {S.name_key("topper")} <> ''),
n AS (SELECT DISTINCT {S.name_key("topper")} AS person, {S.base("url")} AS new_url FROM link_copies WHERE {S.base("url")} <> '' AND {S.name_key("topper")} <> '')"""

ORACLE = {
    "denylist_anti": f"""SELECT submission_id AS ord, {S.q_key("question")} AS qkey, {S.base("url")} AS base FROM submissions
WHERE {S.q_key("question")} NOT IN (SELECT {S.q_key("question")} FROM ocr_questions WHERE salvaged) AND {S.base("url")} NOT IN (SELECT {S.base("url")} FROM link_copies)""",
    "url_rewrite": rf"""SELECT submission_id, CASE WHEN {S.base("url")} LIKE '%\_copy.pdf' ESCAPE '\' THEN 'https://moved.example/' || {S.slug(S.base("url"))} ELSE {S.base("url")} END
  || CASE WHEN contains(url, '#') AND regexp_replace(trim(url), '^[^#]*#', '') <> '' THEN '#' || regexp_replace(trim(url), '^[^#]*#', '') ELSE '' END AS url,
  {S.base("url")} LIKE '%\_copy.pdf' ESCAPE '\' AS is_moved FROM submissions""",
    "override_full_outer": f"""WITH l AS (SELECT {S.name_key("topper")} AS key, arg_min(air, copy_id) FILTER (air IS NOT NULL) AS air, arg_min(year, copy_id) FILTER (year IS NOT NULL) AS year FROM link_copies WHERE {S.name_key("topper")} <> '' GROUP BY 1),
r AS (SELECT {S.name_key("topper")} AS key, arg_min(air, rec_id) FILTER (air IS NOT NULL) AS air, arg_min(year, rec_id) FILTER (year IS NOT NULL) AS year FROM toppers WHERE {S.name_key("topper")} <> '' GROUP BY 1)
SELECT coalesce(l.key, r.key) AS key, coalesce(r.air, l.air) AS air, coalesce(r.year, l.year) AS year, CASE WHEN r.key IS NULL THEN 'left' WHEN l.key IS NULL THEN 'right' ELSE 'both' END AS side FROM l FULL JOIN r ON l.key = r.key""",
    "range_part_lookup": f"""WITH c AS (SELECT {S.paper("subject")} AS part, count(*) AS n FROM submissions GROUP BY 1), s AS (SELECT part, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM c)
SELECT submission_id, part FROM submissions ASOF JOIN s ON submission_id >= start""",
    "link_admission": f"""WITH l AS (SELECT *, {S.base("url")} AS base FROM link_copies), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY copy_id) AS k FROM l)
SELECT copy_id, CASE WHEN base = '' OR coalesce(trim(topper), '') IN ('', 'Unknown') OR coalesce(trim(paper), '') = '' THEN 'lacks a field'
  WHEN base IN (SELECT {S.base("url")} FROM submissions WHERE {S.base("url")} <> '') THEN 'searchable' WHEN k > 1 THEN 'repeat' ELSE 'taken' END AS reason FROM k""",
    "positional_pairing": f"""WITH {_SIDES}, a AS (SELECT person, count(*) AS n_old FROM o GROUP BY 1), b AS (SELECT person, count(*) AS n_new FROM n GROUP BY 1),
j AS (SELECT coalesce(n_old, 0) AS n_old, coalesce(n_new, 0) AS n_new FROM a FULL JOIN b ON a.person = b.person)
SELECT CASE WHEN n_new = 0 THEN 'no new' WHEN n_old = 0 THEN 'fresh' WHEN n_old = n_new THEN 'paired' ELSE 'count mismatch' END AS outcome, count(*) AS n_persons, sum(n_old)::BIGINT AS n_old, sum(n_new)::BIGINT AS n_new FROM j GROUP BY 1""",
    "positional_pairs": f"""WITH {_SIDES}, a AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY old_url) AS k, count(*) OVER (PARTITION BY person) AS c FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY new_url) AS k, count(*) OVER (PARTITION BY person) AS c FROM n) SELECT a.person, old_url, new_url FROM a JOIN b USING (person, k, c)""",
    "missing_extra_keys": f"SELECT key, 'missing' AS side FROM {_K('submissions')} WHERE key NOT IN (SELECT key FROM {_K('toppers')}) UNION ALL SELECT key, 'extra' FROM {_K('toppers')} WHERE key NOT IN (SELECT key FROM {_K('submissions')})",
    "upsert_merge": f"""WITH f AS (SELECT {S.base("url")} AS base, arg_min({S.paper("subject")}, submission_id) AS paper FROM submissions WHERE {S.base("url")} <> '' GROUP BY 1),
p AS (SELECT {S.base("url")} AS base, arg_min({S.paper("paper")}, copy_id) AS paper FROM link_copies WHERE {S.base("url")} <> '' GROUP BY 1)
SELECT base, 'fresh' AS origin, paper FROM f UNION ALL SELECT base, 'kept', paper FROM p WHERE base NOT IN (SELECT base FROM f)""",
    "set_operations": f"""WITH a AS {_K("submissions")}, b AS {_K("toppers")}, c AS {_K("link_copies")}
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'union all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b) + (SELECT count(*) FROM c)""",
}
