"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.functions import text as T
from pustaka.operators import aggregates as A
from pustaka.plans import sql as S
from pustaka.session import read
from pustaka.sources.corpus import rows_sql, source_rows


def build_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.copies(source_rows(spark, sf_dir))


def facet_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_rows(spark, sf_dir).withColumn("source", F.lower(F.trim("coaching")))
    return A.facets(rows, ["paper", "source", "prov"])


def array_facet_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 words of eight letters or more that most documents hold."""
    words = F.filter(T.index_tokens(F.col("text")), lambda t: t.rlike(r"^\p{L}{8,}$"))
    return A.array_facet(read(spark, sf_dir, "documents"), words, 20)


def stats_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = source_rows(spark, sf_dir)
    return r.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("paper") == "Optional").alias("n_optional"),
        F.count_if(F.col("marks") != "").alias("n_with_marks"),
        F.count_distinct(F.when(F.col("base") != "", F.col("base"))).alias("n_copies"),
        F.count_distinct(F.nullif(T.name_key(F.col("topper")), F.lit(""))).alias("n_persons"),
        F.sum(F.length(T.blank(F.col("question"))).cast("long")).alias("n_chars"),
    )


def first_nonnull_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per person the first rank and, for itself, the first year that a statement holds."""
    t = read(spark, sf_dir, "toppers").withColumn("key", T.name_key(F.col("topper")))
    return t.filter("key <> ''").groupBy("key").agg(A.first_stated("air", "rec_id").alias("air"), A.first_stated("year", "rec_id").alias("year"), F.count(F.lit(1)).alias("n"))


def unanimous_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per person the rank that all file names with one give."""
    s = read(spark, sf_dir, "submissions").select(T.name_key(F.col("topper")).alias("key"), T.file_rank(F.col("url")).alias("rank"))
    return s.filter("key <> ''").groupBy("key").agg(A.unanimous("rank").alias("hint"), F.count("rank").alias("n_hints"))


def provenance_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.copies(source_rows(spark, sf_dir))
    return c.groupBy("prov").agg(F.count(F.lit(1)).alias("n_copies"), F.sum("n_rows").alias("n_rows"))


def person_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per person: copies, rows, and the papers in order, joined."""
    r = source_rows(spark, sf_dir).withColumn("key", T.name_key(F.col("topper"))).filter("key NOT IN ('', 'unknown')")
    return r.groupBy("key").agg(F.count_distinct(F.when(F.col("base") != "", F.col("base"))).alias("n_copies"), F.count(F.lit(1)).alias("n_rows"), F.array_join(F.array_sort(F.collect_set("paper")), "; ").alias("papers"))


def topper_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per roll number and paper the marks stated last, from the maps of all its records."""
    t = read(spark, sf_dir, "toppers").filter("roll_no IS NOT NULL").select(F.upper(F.regexp_replace("roll_no", r"[\s-]", "")).alias("roll"), "rec_id", F.explode("marks").alias("paper", "mark"))
    return t.groupBy("roll", "paper").agg(F.max_by("mark", "rec_id").alias("mark"))


def group_median_low_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.copies(source_rows(spark, sf_dir)).withColumn("source", F.coalesce(F.lower(F.trim("coaching")), F.lit("")))
    return A.low_yield(c.select("base", "source", "n_rows"), "source", "n_rows").select("base", "source", "n_rows", "median", "low")


QUERIES = {f.__name__: f for f in (build_copies, facet_grouping_sets, array_facet_count, stats_conditional, first_nonnull_by_order, unanimous_hint, provenance_mixed, person_records, topper_marks, group_median_low_yield)}

_COPIES = (
    "WITH "
    + rows_sql()
    + """, copies AS (SELECT base, arg_min(topper, ord) FILTER (trim(topper) <> '') AS topper, arg_min(coaching, ord) FILTER (trim(coaching) <> '') AS coaching, arg_min(subject, ord) FILTER (trim(subject) <> '') AS subject,
  arg_min(paper, ord) AS paper, CASE WHEN count(DISTINCT prov) > 1 THEN 'mixed' ELSE min(prov) END AS prov, count(*) AS n_rows, count(DISTINCT page) AS n_pages, min(page) AS first_page FROM src WHERE base <> '' GROUP BY base)"""
)

ORACLE = {
    "build_copies": _COPIES + " SELECT * FROM copies",
    "facet_grouping_sets": "WITH "
    + rows_sql()
    + """, s AS (SELECT paper, lower(trim(coaching)) AS source, prov FROM src)
SELECT 'paper' AS facet, paper AS value, count(*) AS n FROM s WHERE paper IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM s WHERE source IS NOT NULL GROUP BY 2 UNION ALL SELECT 'prov', prov, count(*) FROM s WHERE prov IS NOT NULL GROUP BY 2""",
    "array_facet_count": rf"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter({S.tokens("text")}, lambda t: regexp_full_match(t, '\p{{L}}{{8,}}')))) AS value FROM documents)
SELECT value, count(*) AS n FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "stats_conditional": "WITH "
    + rows_sql()
    + f""" SELECT count(*) AS n_rows, count(*) FILTER (paper = 'Optional') AS n_optional, count(*) FILTER (marks <> '') AS n_with_marks, count(DISTINCT nullif(base, '')) AS n_copies,
  count(DISTINCT nullif({S.name_key("topper")}, '')) AS n_persons, sum(length(coalesce(question, '')))::BIGINT AS n_chars FROM src""",
    "first_nonnull_by_order": f"SELECT {S.name_key('topper')} AS key, arg_min(air, rec_id) FILTER (air IS NOT NULL) AS air, arg_min(year, rec_id) FILTER (year IS NOT NULL) AS year, count(*) AS n FROM toppers WHERE {S.name_key('topper')} <> '' GROUP BY 1",
    "unanimous_hint": rf"""WITH s AS (SELECT {S.name_key("topper")} AS key, try_cast(regexp_extract(split_part({S.base("url")}, '/', -1), '(?i)(?:^|[-_ .])rank[-_ ]?(\d{{1,3}})(?:\D|$)', 1) AS INT) AS rank FROM submissions)
SELECT key, CASE WHEN count(DISTINCT rank) = 1 THEN min(rank) END AS hint, count(rank) AS n_hints FROM s WHERE key <> '' GROUP BY key""",
    "provenance_mixed": _COPIES + " SELECT prov, count(*) AS n_copies, sum(n_rows)::BIGINT AS n_rows FROM copies GROUP BY prov",
    "person_records": "WITH "
    + rows_sql()
    + f""", k AS (SELECT *, {S.name_key("topper")} AS key FROM src) SELECT key, count(DISTINCT nullif(base, '')) AS n_copies, count(*) AS n_rows, string_agg(DISTINCT paper, '; ' ORDER BY paper) AS papers
FROM k WHERE key NOT IN ('', 'unknown') GROUP BY key""",
    "topper_marks": r"""WITH t AS (SELECT upper(regexp_replace(roll_no, '[\s-]', '', 'g')) AS roll, rec_id, unnest(map_entries(marks)) AS e FROM toppers WHERE roll_no IS NOT NULL)
SELECT roll, e.key AS paper, arg_max(e.value, rec_id) AS mark FROM t GROUP BY 1, 2""",
    "group_median_low_yield": _COPIES
    + """, s AS (SELECT base, coalesce(lower(trim(coaching)), '') AS source, n_rows FROM copies), m AS (SELECT *, median(n_rows) OVER (PARTITION BY source) AS median FROM s)
SELECT *, n_rows < greatest(8.0, median * 0.6) AS low FROM m""",
}
