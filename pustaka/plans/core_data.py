"""Queries of the general training-data operators: records that do not parse, and keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pustaka.operators.hot_keys import heavy_keys, per_key
from pustaka.session import read
from pustaka.sources.csv_records import parse_records, rejected, typed


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(parse_records(read(spark, sf_dir, "submission_lines")))


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(parse_records(read(spark, sf_dir, "submission_lines")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "submissions")
    return heavy_keys(per_key(rows), rows.count())


def p7_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_key(read(spark, sf_dir, "submissions"))


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p7_found": p7_found, "p7_per_key": p7_per_key}

_RECORDS = r"""
WITH r AS (SELECT record_id, regexp_replace(coalesce(raw_record, ''), '\r$', '') AS rec FROM submission_lines),
q AS (SELECT *, regexp_full_match(rec, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', 's') AS quoted FROM r),
f AS (SELECT *, CASE WHEN quoted THEN regexp_extract_all(',' || rec, ',("(?:[^"]|"")*"|[^",]*)', 1) ELSE [] END AS fields FROM q),
v AS (SELECT *, list_transform(fields, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM f),
t AS (SELECT *, len(v) AS n, regexp_replace(v[5], '^\s+|\s+$', '', 'g') AS question_t, regexp_replace(v[7], '^\s+|\s+$', '', 'g') AS url_t FROM v),
c AS (SELECT *, NOT quoted AS bad_quote, quoted AND n <> 7 AS bad_count,
  quoted AND n = 7 AND (NOT regexp_matches(question_t, '\p{L}') OR regexp_matches(question_t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{fffd}]')) AS bad_question,
  quoted AND n = 7 AND NOT regexp_full_match(url_t, '(?i)https?://[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::[0-9]+)?(?:[/?#]\S*)?') AS bad_url FROM t)
"""

_KEYED = """
WITH k AS (
  SELECT 'coaching' AS field_name, lower(trim(coaching)) AS key_value, submitted_at AS ts, submission_id AS id, coalesce(prov, '') AS tag FROM submissions
  UNION ALL
  SELECT 'subject', lower(trim(subject)), submitted_at, submission_id, coalesce(prov, '') FROM submissions),
"""

ORACLE = {
    "p1_found": _RECORDS
    + """SELECT record_id, 'quoting' AS reason FROM c WHERE bad_quote UNION ALL SELECT record_id, 'column_count' FROM c WHERE bad_count
UNION ALL SELECT record_id, 'question' FROM c WHERE bad_question UNION ALL SELECT record_id, 'url' FROM c WHERE bad_url""",
    "p1_loaded": _RECORDS
    + r"""SELECT record_id, nullif(trim(v[1]), '') AS topper, nullif(trim(v[2]), '') AS coaching, nullif(trim(v[3]), '') AS subject,
  nullif(try_cast(regexp_extract(v[4], '^\s*([+-]?\d+)', 1) AS INT), 0) AS page, nullif(trim(v[5]), '') AS question,
  nullif(trim(v[6]), '') AS metadata, nullif(trim(v[7]), '') AS url
FROM c WHERE NOT (bad_quote OR bad_count OR bad_question OR bad_url)""",
    "p7_found": _KEYED
    + """n AS (SELECT count(*) AS n FROM submissions)
SELECT field_name, key_value FROM k, n WHERE key_value IS NOT NULL GROUP BY field_name, key_value, n HAVING count(*) >= 0.05 * n""",
    "p7_per_key": _KEYED
    + """g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, CASE WHEN lag(tag) OVER w = tag THEN 0 ELSE 1 END AS turn, row_number() OVER w AS rn
  FROM k WHERE key_value IS NOT NULL WINDOW w AS (PARTITION BY field_name, key_value ORDER BY ts NULLS FIRST, id)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY field_name, key_value ORDER BY rn) AS run FROM g),
u AS (SELECT field_name, key_value, run, count(*) AS len FROM r GROUP BY ALL),
a AS (SELECT field_name, key_value, count(*) AS n_rows, min(ts) AS first_at, max(ts) AS last_at, max(gap) // 1000000 AS max_gap_s FROM g GROUP BY ALL),
b AS (SELECT field_name, key_value, count(*) AS n_runs, max(len) AS longest_run FROM u GROUP BY ALL)
SELECT field_name, key_value, n_rows, first_at, last_at, max_gap_s, n_runs, longest_run FROM a JOIN b USING (field_name, key_value)""",
}
