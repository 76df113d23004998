"""Queries of the keys and short forms of names, files and texts, and of what is dropped by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.functions import names as N
from pustaka.functions import text as T
from pustaka.operators import dedupe as D
from pustaka.plans import sql as S
from pustaka.session import read
from pustaka.sources.corpus import source_rows


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("topper")
    return read(spark, sf_dir, "submissions").select("submission_id", N.ascii_key(t).alias("ascii_key"), N.clean_name(t).alias("clean"), N.base_subject(F.col("subject")).alias("base_subject"))


def file_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "submissions").select("submission_id", N.file_year(u).alias("year"), N.file_test(u).alias("test"), N.file_person(u).alias("person"))


def decoded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as a browser would write them, decoded again."""
    u = read(spark, sf_dir, "submissions").select("submission_id", F.replace(F.concat(F.col("url"), F.lit(" 100% ✓")), F.lit("%"), F.lit("%25")).alias("u"))
    return u.select("submission_id", N.decoded(F.replace(F.col("u"), F.lit(" "), F.lit("%20"))).alias("url"))


def short_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "submissions").select("submission_id", *[N.short_key(F.col("question"), k).alias(f"key{k}") for k in (48, 60, 64)])


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    marked = F.concat(F.lit("<b>"), q, F.lit("</b> & 'x' \"y\""))
    return read(spark, sf_dir, "submissions").select("submission_id", N.html(marked).alias("html"), N.script_json(marked).alias("json"), N.clip(q, 80).alias("clip"))


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    d = read(spark, sf_dir, "submissions").filter("question IS NOT NULL").select("submission_id", F.md5(q).alias("md5"), F.substring(F.sha1(q), 1, 8).alias("sha1_8"))
    return d.withColumn("base32", N.base32_of_hex(F.col("md5")))


def link_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What describes a link, in a row: its rank, year, paper and source, those that are stated."""
    air = F.when(F.col("air").isNotNull(), F.concat(F.lit("AIR "), F.col("air")))
    return read(spark, sf_dir, "link_copies").select("copy_id", N.tags(air, F.col("year").cast("string"), "paper", "source").alias("tags"))


def page_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the questions of a booklet that begin alike only the first is kept, in the order of its rows."""
    q = read(spark, sf_dir, "ocr_questions").select("unit_key", "ocr_id", N.short_key(F.col("question"), 48).alias("key")).filter("key <> ''")
    return q.groupBy("unit_key", "key").agg(F.min("ocr_id").alias("ocr_id"), (F.count(F.lit(1)) - 1).alias("n_dropped"))


def emit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per address and key of 64 characters the first question by page, then by row."""
    q = read(spark, sf_dir, "ocr_questions").select("url", "page", "ocr_id", N.short_key(F.col("question"), 64).alias("key")).filter("url IS NOT NULL AND key <> ''")
    return q.groupBy("url", "key").agg(F.min_by("ocr_id", F.struct(F.coalesce("page", F.lit(-1)).alias("p"), "ocr_id")).alias("ocr_id"))


def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by content: the copy that held a text first has its digest, any other the digest and a suffix of its own."""
    r = source_rows(spark, sf_dir).filter("base <> '' AND question IS NOT NULL").groupBy(F.sha2("question", 256).alias("digest"), "base").agg(F.min("ord").alias("ord"))
    own = r.groupBy("digest").agg(F.min_by("base", "ord").alias("owner"))
    key = F.when(F.col("base") == F.col("owner"), F.col("digest")).otherwise(F.concat("digest", F.lit("-"), F.substring(F.sha1("base"), 1, 8)))
    return r.join(own, "digest").select("base", "ord", F.concat(key, F.lit(".pdf")).alias("key"))


def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a checked question word for word."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.norm(F.col("text")).alias("norm"))
    items = read(spark, sf_dir, "ocr_labels").select("ocr_id", T.norm(F.col("clean_text")).alias("norm"))
    return D.holders(docs, items, "doc_id", "ocr_id")


QUERIES = {f.__name__: f for f in (name_keys, file_parts, decoded_urls, short_keys, escaped, digests, link_tags, page_suppression, emit_dedupe, content_identity, benchmark_containment)}

_SHORT = lambda c, k: f"substr(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g'), 1, {k})"
_FN = f"split_part({S.base('url')}, '/', -1)"
_MARKED = "'<b>' || question || '</b> & ''x'' \"y\"'"

ORACLE = {
    "name_keys": r"""SELECT submission_id, regexp_replace(lower(coalesce(topper, '')), '[^a-z0-9]+', '', 'g') AS ascii_key,
  trim(regexp_replace(regexp_replace(coalesce(topper, ''), '\s+UPSC\b.*\bTopper\b.*$', '', 'i'), '\s+Rank$', '', 'i')) AS clean,
  CASE WHEN subject LIKE 'General Studies%' THEN subject ELSE regexp_replace(coalesce(subject, ''), '\s+(?:I|II)$', '') END AS base_subject FROM submissions""",
    "file_parts": rf"""WITH f AS (SELECT submission_id, {_FN} AS fn FROM submissions), r AS (SELECT *, regexp_extract_all(regexp_replace(fn, '\.pdf$', '', 'i'), '\d+') AS runs FROM f)
SELECT submission_id, try_cast(regexp_extract(fn, '(?:^|\D)(20(?:1[5-9]|2[0-6]))(?:\D|$)', 1) AS INT) AS year,
  try_cast(CASE WHEN regexp_matches(fn, '(?i)^(?:[0-9a-f]+-)?\d+[_-]\d+[_-]?.*\.pdf$') THEN regexp_extract(fn, '(?i)^(?:[0-9a-f]+-)?\d+[_-](\d+)', 1) WHEN len(runs) >= 2 THEN runs[-1] END AS BIGINT) AS test,
  regexp_replace(regexp_extract(fn, '(?i)^\d+[_-](.*?)\.pdf$', 1), '[_-]+(?:rank.*|air.*|\d.*)$', '', 'i') AS person FROM r""",
    "decoded_urls": "SELECT submission_id, url || ' 100% ✓' AS url FROM submissions",
    "short_keys": f"SELECT submission_id, {_SHORT('question', 48)} AS key48, {_SHORT('question', 60)} AS key60, {_SHORT('question', 64)} AS key64 FROM submissions",
    "escaped": f"""SELECT submission_id, replace(replace(replace(replace(replace({_MARKED}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
  replace({_MARKED}, '<', '\\u003c') AS json, CASE WHEN length(question) > 80 THEN substr(question, 1, 79) || '…' ELSE question END AS clip FROM submissions""",
    "digests": """WITH d AS (SELECT submission_id, md5(question) AS md5, substr(sha1(question), 1, 8) AS sha1_8 FROM submissions WHERE question IS NOT NULL), n AS (SELECT *, ('0x' || substr(md5, 1, 10))::BIGINT AS n FROM d)
SELECT submission_id, md5, sha1_8, list_aggregate(list_transform(range(0, 8), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', (((n >> (35 - 5 * i)::BIGINT) & 31) + 1)::INT, 1)), 'string_agg', '') AS base32 FROM n""",
    "link_tags": "SELECT copy_id, concat_ws(' · ', 'AIR ' || air, year::VARCHAR, paper, source) AS tags FROM link_copies",
    "page_suppression": f"SELECT unit_key, {_SHORT('question', 48)} AS key, min(ocr_id) AS ocr_id, count(*) - 1 AS n_dropped FROM ocr_questions WHERE {_SHORT('question', 48)} <> '' GROUP BY 1, 2",
    "emit_dedupe": f"""WITH r AS (SELECT url, {_SHORT("question", 64)} AS key, ocr_id, row_number() OVER (PARTITION BY url, {_SHORT("question", 64)} ORDER BY coalesce(page, -1), ocr_id) AS k FROM ocr_questions WHERE url IS NOT NULL)
SELECT url, key, ocr_id FROM r WHERE k = 1 AND key <> ''""",
    "content_identity": f"""WITH r AS (SELECT sha256(question) AS digest, {S.base("url")} AS base, min(submission_id) AS ord FROM submissions WHERE question IS NOT NULL AND {S.base("url")} <> '' GROUP BY 1, 2)
SELECT base, ord, digest || CASE WHEN row_number() OVER (PARTITION BY digest ORDER BY ord) = 1 THEN '' ELSE '-' || substr(sha1(base), 1, 8) END || '.pdf' AS key FROM r""",
    "benchmark_containment": f"""WITH i AS (SELECT ocr_id, {S.norm("clean_text")} AS n FROM ocr_labels), d AS (SELECT doc_id, {S.norm("text")} AS n FROM documents)
SELECT doc_id, ocr_id FROM d JOIN i ON contains(' ' || d.n || ' ', ' ' || i.n || ' ') WHERE len(string_split(i.n, ' ')) >= 5""",
}
