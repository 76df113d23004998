"""Queries of the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pustaka.operators import classify as C

from pustaka.session import read
from pustaka.sources.corpus import rows_sql, source_rows


def fragment_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rows(spark, sf_dir).select("ord", C.route(F.col("question"), F.col("marks"), F.col("words"), F.col("paper")).alias("route"))


def question_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rows(spark, sf_dir).select("ord", C.confidence(F.col("question"), F.col("marks"), F.col("words")).alias("score"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rows(spark, sf_dir).filter("question IS NOT NULL").select(F.col("ord").alias("key"), "paper", F.col("question").alias("text"))


def keyword_topk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classes(_texts(spark, sf_dir), read(spark, sf_dir, "syllabus_nodes"))


def syllabus_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.classes(_texts(spark, sf_dir), read(spark, sf_dir, "syllabus_nodes")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("score").alias("score"))
    return read(spark, sf_dir, "syllabus_nodes").select("node_id", "paper", "label").join(c, "node_id", "left").na.fill(0, ["n_rows", "score"])


def quality_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.trim(F.regexp_replace("question", r"\s+", " "))
    return read(spark, sf_dir, "ocr_questions").filter("question IS NOT NULL").select("ocr_id", C.first_failed(q).alias("gate"))


def paper_audit_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paper_votes(_texts(spark, sf_dir), read(spark, sf_dir, "syllabus_nodes"))


def cut_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned questions of a booklet, in its order, glued to the next one while they end without a closing mark: (unit_key, first_id, n_parts, length)."""
    q = read(spark, sf_dir, "ocr_questions").filter("question IS NOT NULL AND unit_key IS NOT NULL")
    by = Window.partitionBy("unit_key").orderBy("ocr_id")
    open_end = ~F.col("question").rlike(r"[.?!।)\]M]\s*$")
    flagged = q.select("unit_key", "ocr_id", F.length("question").alias("len"), open_end.alias("open")).withColumn("starts", (~F.coalesce(F.lag("open").over(by), F.lit(False))).cast("int"))
    island = flagged.withColumn("island", F.sum("starts").over(by))
    return island.groupBy("unit_key", "island").agg(F.min("ocr_id").alias("first_id"), F.count(F.lit(1)).alias("n_parts"), F.sum("len").alias("length")).drop("island")


QUERIES = {f.__name__: f for f in (fragment_router, question_confidence, keyword_topk_classes, syllabus_node_counts, quality_gate_reasons, paper_audit_votes, cut_stitch)}

# Fixed values, written out, so that the twins do not rest on the code they check.
_DIRECTIVE = (
    r"(?i)\b(?:discuss|examine|analyse|analyze|elucidate|evaluate|comment|critically|substantiate|illustrate|justify|explain|describe|suggest|highlight|enumerate|do you agree|to what extent|account for|bring out)\b"
)
_OPENER = (
    r"(?i)^\s*(?:so|now|then|thus|hence|however|moreover|furthermore|therefore|also|having discussed|now having|as discussed|from the above|in conclusion|to conclude|why (?:still|is it still)|what (?:is|was) the result|how did it|how can we|can it be said|is there a way)\b"
)
_ETHICS = r"(?i)\b(?:ethic|ethical|integrity|probity|conscience|moral|dilemma|whistle ?blow|corrupt|values?|emotional intelligence|case study|civil servant)\b"
_ESSAY_VERB = r"(?i)\b(?:discuss|examine|analyse|analyze|elucidate|comment|evaluate)\b"
_SAME = "|".join(f"{c}{{5,}}" for c in [r"\." if c == "." else rf"\{c}" if c in r"\^$|?*+()[]{}-" else c.replace("'", "''") for c in map(chr, range(32, 127))])
_LETTERS = r"length(regexp_replace(coalesce(question, ''), '[^\p{L}\p{N}]+', '', 'g'))"
_CLASSES = (
    "WITH "
    + rows_sql()
    + """, k AS (SELECT ord AS key, node_id, list_sum(list_transform(kw, lambda w: CASE WHEN contains(lower(question), w) THEN least(length(w), 24) ELSE 0 END))::INT AS score FROM src JOIN syllabus_nodes n ON src.paper = n.paper WHERE question IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, node_id) AS place FROM k WHERE score > 0), cl AS (SELECT key, node_id, score, place FROM p WHERE place <= 2 AND score >= 8)"""
)

ORACLE = {
    "fragment_router": "WITH "
    + rows_sql()
    + rf""", n AS (SELECT *, trim(coalesce(question, '')) AS q, {_LETTERS} AS n, regexp_matches(coalesce(question, ''), '(?i)^\s*\(?[a-e][).]') AS lettered FROM src),
f AS (SELECT *, CASE WHEN q = '' THEN true WHEN marks <> '' OR words <> '' THEN false WHEN regexp_matches(q, '(?i)^\s*(?:Q\.?\s*)?\d+\s*[).:\-]') THEN false WHEN paper <> 'Essay' AND n < 22 THEN true
  WHEN paper <> 'Essay' AND n < 60 AND regexp_matches(q, '(?i)\b(?:you|your)\b') THEN true ELSE regexp_matches(q, '{_OPENER}') AND n < 130 END AS fragment FROM n)
SELECT ord, CASE WHEN fragment THEN 'fragment' WHEN (lettered AND (paper = 'GS4' OR length(question) < 90)) OR n < 12 OR (contains(question, chr(10)) AND regexp_matches(question, '--?>|→')) THEN 'part' ELSE 'question' END AS route FROM f""",
    "question_confidence": "WITH "
    + rows_sql()
    + f""", n AS (SELECT *, coalesce(question, '') AS q FROM src)
SELECT ord, ((length(q) >= 40)::INT + contains(q, '?')::INT + 2 * regexp_matches(q, '{_DIRECTIVE}')::INT + (marks <> '' OR words <> '')::INT
  - 2 * (length(regexp_replace(q, '[^A-Za-z]', '', 'g')) / greatest(length(q), 1) < 0.6)::INT - 2 * regexp_matches(q, '{_SAME}')::INT) AS score FROM n""",
    "keyword_topk_classes": _CLASSES + " SELECT * FROM cl",
    "syllabus_node_counts": _CLASSES + " SELECT n.node_id, n.paper, n.label, count(key) AS n_rows, coalesce(sum(score), 0)::BIGINT AS score FROM syllabus_nodes n LEFT JOIN cl USING (node_id) GROUP BY ALL",
    "quality_gate_reasons": rf"""WITH t AS (SELECT ocr_id, trim(regexp_replace(question, '\s+', ' ', 'g')) AS t FROM ocr_questions WHERE question IS NOT NULL),
w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: regexp_matches(x, '[A-Za-z]')) AS w FROM t)
SELECT ocr_id, CASE WHEN length(t) < 35 THEN 'too short' WHEN length(t) > 900 THEN 'too long' WHEN NOT regexp_matches(t, '^["“''‘]?[A-Z]') THEN 'no capital first' WHEN regexp_matches(t, '[\x{{0900}}-\x{{0DFF}}]') THEN 'other script'
  WHEN length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / greatest(length(t), 1) < 0.62 THEN 'few letters' WHEN len(w) < 7 THEN 'few words'
  WHEN len(list_filter(w, lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) <= 2)) / greatest(len(w), 1) > 0.4 THEN 'tiny words' WHEN len(list_filter(w, lambda x: regexp_matches(x, '(?i)[bcdfghjklmnpqrstvwxz]{{5}}'))) > 0 THEN 'no vowel'
  WHEN NOT (regexp_matches(t, '{_DIRECTIVE}') OR contains(t, '?')) THEN 'no directive' ELSE 'passed' END AS gate FROM w""",
    "paper_audit_votes": "WITH "
    + rows_sql()
    + rf""", t AS (SELECT ord AS key, paper, question AS text FROM src WHERE question IS NOT NULL),
k AS (SELECT t.key, t.paper, n.paper AS np, max(list_sum(list_transform(n.kw, lambda w: CASE WHEN contains(lower(text), w) THEN least(length(w), 24) ELSE 0 END))) AS score FROM t, syllabus_nodes n WHERE t.paper LIKE 'GS_' AND n.paper LIKE 'GS_' GROUP BY ALL),
b AS (SELECT key, arg_max(np, (score, -right(np, 1)::INT)) AS top, max(score) AS ts, max(CASE WHEN np = paper THEN score ELSE 0 END) AS own FROM k GROUP BY key),
v AS (SELECT t.key, paper, CASE WHEN ts >= 16 AND ts > 2 * own THEN top END AS by_words, regexp_matches(text, '{_ETHICS}') AS e, text FROM t LEFT JOIN b USING (key)),
x AS (SELECT key, paper, by_words, CASE WHEN e AND paper NOT IN ('GS4', 'Essay') THEN 'GS4' WHEN NOT e AND paper = 'GS4' AND length(text) > 120 THEN 'not GS4' END AS by_ethics,
  CASE WHEN NOT contains(text, '?') AND length(text) < 160 AND NOT regexp_matches(text, '{_ESSAY_VERB}') AND paper <> 'Essay' AND length(text) > 20 THEN 'Essay' END AS by_shape FROM v),
y AS (SELECT *, list_filter([by_words, nullif(by_ethics, 'not GS4'), by_shape], lambda z: z IS NOT NULL) AS votes FROM x)
SELECT key, paper, by_words, by_ethics, by_shape, CASE WHEN len(votes) >= 2 THEN votes[1] END AS suggest FROM y WHERE by_words IS NOT NULL OR by_ethics IS NOT NULL OR by_shape IS NOT NULL""",
    "cut_stitch": r"""WITH q AS (SELECT unit_key, ocr_id, length(question) AS len, NOT regexp_matches(question, '[.?!।)\]M]\s*$') AS open FROM ocr_questions WHERE question IS NOT NULL AND unit_key IS NOT NULL),
s AS (SELECT *, CASE WHEN coalesce(lag(open) OVER w, false) THEN 0 ELSE 1 END AS starts FROM q WINDOW w AS (PARTITION BY unit_key ORDER BY ocr_id)), i AS (SELECT *, sum(starts) OVER (PARTITION BY unit_key ORDER BY ocr_id) AS island FROM s)
SELECT unit_key, min(ocr_id) AS first_id, count(*) AS n_parts, sum(len)::BIGINT AS length FROM i GROUP BY unit_key, island""",
}
