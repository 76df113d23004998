"""Queries of what is written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.operators import aggregates as A
from pustaka.operators import index as I
from pustaka.plans import sql as S
from pustaka.plans.aggregates import _COPIES
from pustaka.session import cut, read, shared_dir
from pustaka.sources import loaders, sinks
from pustaka.sources.corpus import source_rows
from pustaka.sources.csv_records import parse_records

_FIELDS = ["topper", "coaching", "subject", "page_number", "question", "metadata", "url"]


def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_rows(spark, sf_dir)
    return sinks.manifest(sinks.with_parts(I.questions(rows), I.refs(rows)))


def csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "submissions")
    return s.select("submission_id", sinks.csv_lines(s, _FIELDS).alias("line"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV and read again: how many fields of how many rows come back as they were."""
    s = read(spark, sf_dir, "submissions")
    lines = cut(s.select(F.col("submission_id").alias("record_id"), F.lit("all").alias("file_name"), sinks.csv_lines(s, _FIELDS).alias("raw_record")), "lines")
    back = parse_records(lines).select("record_id", *[F.col(c).alias(f"b_{c}") for c in _FIELDS])
    j = s.join(back, F.col("submission_id") == F.col("record_id"))
    same = sum((F.coalesce(F.col(c), F.lit("")) == F.coalesce(F.col(f"b_{c}"), F.lit(""))).cast("int") for c in _FIELDS)
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(same).alias("n_same_fields"))


def csv_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV files with a header of another order, and loaded under their names."""
    path = f"{shared_dir(spark)}/pustaka-csv-{uuid.uuid4().hex}"
    s = read(spark, sf_dir, "submissions")
    s.select(*[F.coalesce(c, F.lit("")).alias(c) for c in reversed(_FIELDS)]).write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    rows = cut(loaders.load_csv(spark, path, "community").unionByName(loaders.load_csv(spark, f"{path}-none", "ocr")), "loaded")
    return rows.groupBy("topper", "page", "url", "prov").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("question")).alias("n_chars"))


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the published data set, written as CSV and JSON, with the rows of each read again."""
    rows = source_rows(spark, sf_dir)
    tables = {"questions": I.questions(rows).select("paper", "text"), "copies": A.copies(rows), "persons": rows.filter("topper IS NOT NULL").groupBy("topper").agg(F.count(F.lit(1)).alias("n_rows"))}
    return sinks.write_dataset(spark, f"{shared_dir(spark)}/pustaka-set-{uuid.uuid4().hex}", tables).select("name", "form", "n_rows", (F.length("sha256") == 64).alias("has_digest"))


QUERIES = {f.__name__: f for f in (shard_manifest, csv_text, csv_round_trip, csv_loaded, dataset_manifest)}

_LINE = " || ',' || ".join(f"(CASE WHEN regexp_matches(coalesce({c}, ''), '[\",\\n\\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END)" for c in _FIELDS)

ORACLE = {
    "csv_loaded": rf"""SELECT coalesce(trim(topper), '') AS topper, nullif(try_cast(regexp_extract(coalesce(page_number, ''), '^\s*([+-]?\d+)', 1) AS INT), 0) AS page, coalesce(trim(url), '') AS url, 'community' AS prov, count(*) AS n, sum(length(trim(coalesce(question, ''))))::BIGINT AS n_chars
FROM submissions WHERE concat(topper, coaching, subject, page_number, question, metadata, url) <> '' GROUP BY ALL""",
    "dataset_manifest": _COPIES + f""", n AS (SELECT 'questions' AS name, count(*) AS n_rows FROM (SELECT DISTINCT paper, {S.norm("question")} AS norm FROM src) WHERE norm <> '' UNION ALL SELECT 'copies', count(*) FROM copies UNION ALL SELECT 'persons', count(DISTINCT topper) FROM src)
SELECT name, unnest(['csv', 'json']) AS form, n_rows, true AS has_digest FROM n""",
    "csv_text": f"SELECT submission_id, {_LINE} AS line FROM submissions",
    "csv_round_trip": "SELECT count(*) AS n_rows, 7 * count(*) AS n_same_fields FROM submissions",
    "shard_manifest": f"""WITH s AS (SELECT submission_id AS ord, {S.paper("subject")} AS paper, {S.norm("question")} AS norm, question, {S.base("url")} AS base FROM submissions),
q AS (SELECT paper, norm, arg_max(question, (length(question), -ord)) AS text, min(base) FILTER (base <> '') AS anchor FROM s WHERE norm <> '' GROUP BY paper, norm),
n AS (SELECT paper, greatest(ceil(sum(strlen(text)) / 600000), 1)::BIGINT AS n_parts FROM q GROUP BY paper),
p AS (SELECT q.*, CASE WHEN anchor IS NULL THEN 2166136261 ELSE {S.fnv32("anchor")} END % n_parts AS part FROM q JOIN n USING (paper))
SELECT paper, part, count(*) AS n_rows, sum(strlen(text))::BIGINT AS n_bytes, sha256(list_aggregate(list_sort(list(sha256(text))), 'string_agg', '')) AS digest FROM p GROUP BY paper, part""",
}
