"""Queries of the smaller operators: entities, scans, chunks, facets of documents, pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.functions import pages as P
from pustaka.functions import text as T
from pustaka.operators import aggregates as A
from pustaka.operators import entities as E
from pustaka.operators.ranking import places
from pustaka.plans import sql as S
from pustaka.session import read
from pustaka.sources.corpus import source_rows


def url_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different URL in the raw text of the records, without query and fragment."""
    u = F.explode(F.regexp_extract_all("raw_record", F.lit(r'(https?://[^\s",]+)'), 1))
    return read(spark, sf_dir, "submission_lines").select(u.alias("u")).select(F.regexp_replace("u", r"[?#].*$", "").alias("url")).distinct()


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a value within the JSON of the events."""
    v = F.from_json("props", "k INT")["k"]
    return read(spark, sf_dir, "events").groupBy("event_type", v.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks of the toppers as JSON objects, read again and taken apart."""
    j = read(spark, sf_dir, "toppers").select("rec_id", F.from_json(F.to_json("marks"), "MAP<STRING,STRING>").alias("m"))
    return j.select("rec_id", F.explode("m").alias("paper", "mark"))


def contact_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "link_copies").filter("topper IS NOT NULL").select(F.col("topper").alias("name"))
    persons = read(spark, sf_dir, "toppers").filter("topper IS NOT NULL").select(F.col("topper").alias("person"))
    return E.tokens_within_one(names, persons)


def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = read(spark, sf_dir, "link_copies").select("copy_id", T.name_key(F.col("topper")).alias("key"), "air", "year").filter("key <> ''")
    known = read(spark, sf_dir, "toppers").select(T.name_key(F.col("topper")).alias("key"), "air", "year").filter("key <> ''")
    return E.collisions(new, known).select("copy_id", "outcome")


def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = source_rows(spark, sf_dir).filter("base <> ''").select(F.col("base").alias("url")).distinct()
    return E.representatives(E.clusters(urls))


def source_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in one spelling, the most frequent one of each key; unknown means none."""
    lc = read(spark, sf_dir, "link_copies").select("copy_id", T.name_key(F.col("source")).alias("key"), "source")
    best = lc.filter("key NOT IN ('', 'unknown')").groupBy("key", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("source", F.struct("n", "source")).alias("name"))
    return lc.join(best, "key", "left").select("copy_id", F.coalesce("name", F.lit("")).alias("source"))


def question_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of scanned questions that hold several, with the marks and words that each states."""
    q = read(spark, sf_dir, "ocr_questions").select("ocr_id", F.posexplode(P.chunks(F.col("question"))).alias("chunk_no", "chunk"))
    return q.select("ocr_id", "chunk_no", "chunk", P.stated_marks(F.col("chunk")).alias("marks"), P.stated_words(F.col("chunk")).alias("words"))


def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: booklets, questions, salvaged ones, pages (40 where none is known) and requests of six pages."""
    u = read(spark, sf_dir, "ocr_questions").groupBy("unit_key").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("n"), F.count_if("salvaged").alias("s"), F.coalesce(F.max("page"), F.lit(40)).alias("pages"))
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_questions"), F.sum("s").alias("n_salvaged"), F.sum("pages").alias("n_pages"), F.sum(F.ceil(F.col("pages") / 6)).alias("n_requests"))


def interview_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interviews that hold all words of a query anywhere in what describes them, newest first."""
    blob = F.lower(F.concat_ws(" ", "source", "paper", "lang", F.col("year").cast("string"), "series_key"))
    d = read(spark, sf_dir, "documents").filter("kind = 'interview_transcript'")
    for term in ("interview", "gs"):
        d = d.filter(F.contains(blob, F.lit(term)))
    return d.select("doc_id", "year", "paper", "n_chars").orderBy(F.desc_nulls_last("year"), "doc_id").limit(25)


def document_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.facets(read(spark, sf_dir, "documents").withColumn("year", F.col("year").cast("string")), ["lang", "source", "kind", "paper", "year"])


def optional_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of one optional subject of which a question, the name or the coaching holds a word that begins with a term."""
    r = source_rows(spark, sf_dir).filter("paper = 'Optional' AND base <> ''").withColumn("s", F.lower(F.trim("subject"))).filter("s = 'sociology'")
    blob = F.lower(F.concat_ws(" ", "topper", "coaching", "question"))
    return r.filter(T.starts_word(blob, "migra")).groupBy("base").agg(F.count(F.lit(1)).alias("n_rows"))


def practice_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per paper the questions that copies answer most: those with three answers if there are 20, else two if 10, else any."""
    r = source_rows(spark, sf_dir).withColumn("norm", T.norm(F.col("question"))).filter("norm <> '' AND base <> ''")
    q = r.groupBy("paper", "norm").agg(F.count_distinct("base").alias("n"))
    t = q.groupBy("paper").agg(F.when(F.count_if(F.col("n") >= 3) >= 20, 3).when(F.count_if(F.col("n") >= 2) >= 10, 2).otherwise(1).alias("least"))
    return q.join(t, "paper").filter("n >= least").groupBy("paper", "least").agg(F.count(F.lit(1)).alias("pool"), F.max("n").alias("most"))


def work_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booklets dealt to eight workers by their place in order: every one goes to exactly one."""
    u = read(spark, sf_dir, "ocr_questions").filter("unit_key IS NOT NULL").groupBy("unit_key").agg(F.count(F.lit(1)).alias("n"))
    return places(u, ["unit_key"], "no").withColumn("worker", (F.col("no") - 1) % 8).groupBy("worker").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_questions"))


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the words marked that begin with a term."""
    q = source_rows(spark, sf_dir).filter(T.starts_word(F.lower("question"), "feder"))
    return q.select("ord", F.regexp_replace("question", r"(?i)(?<![\p{L}\p{M}\p{N}])(feder)", "<mark>$1</mark>").alias("shown"))


QUERIES = {f.__name__: f for f in (url_scan, json_values, json_round_trip, contact_token_match, name_collisions, cluster_representatives, source_alias, question_chunks, scan_status, interview_search, document_facets, optional_search, practice_pool, work_shards, highlighted)}

_TOK = lambda t, c: f"(SELECT DISTINCT topper AS {c}, unnest(list_distinct(list_filter(string_split({S.name_key('topper')}, ' '), lambda x: length(x) >= 3))) AS t FROM {t} WHERE topper IS NOT NULL)"

ORACLE = {
    "url_scan": r"""SELECT DISTINCT regexp_replace(u, '[?#].*$', '') AS url FROM (SELECT unnest(regexp_extract_all(raw_record, 'https?://[^\s",]+')) AS u FROM submission_lines)""",
    "json_values": "SELECT event_type, json_extract(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY ALL",
    "json_round_trip": "SELECT rec_id, e.key AS paper, e.value AS mark FROM (SELECT rec_id, unnest(map_entries(marks)) AS e FROM toppers)",
    "contact_token_match": f"""WITH n AS {_TOK("link_copies", "name")}, p AS {_TOK("toppers", "person")}, s AS (SELECT name, count(*) AS n FROM n GROUP BY 1),
f AS (SELECT name, person FROM n JOIN p USING (t) JOIN s USING (name) GROUP BY name, person, s.n HAVING count(*) = s.n),
x AS (SELECT a.topper AS name, min(b.topper) AS person FROM (SELECT DISTINCT topper FROM link_copies) a JOIN (SELECT DISTINCT topper FROM toppers) b ON {S.name_key("a.topper")} = {S.name_key("b.topper")} WHERE a.topper IS NOT NULL AND b.topper IS NOT NULL GROUP BY 1),
o AS (SELECT name, min(person) AS person FROM f GROUP BY name HAVING count(*) = 1) SELECT * FROM x UNION ALL SELECT * FROM o WHERE name NOT IN (SELECT name FROM x)""",
    "name_collisions": f"""WITH n AS (SELECT copy_id, {S.name_key("topper")} AS key, air, year FROM link_copies), k AS (SELECT {S.name_key("topper")} AS key, air, year FROM toppers),
j AS (SELECT n.copy_id, count(k.key) AS c, bool_or(n.air IS NOT DISTINCT FROM k.air AND n.year IS NOT DISTINCT FROM k.year) AS same, bool_or(k.air IS NOT NULL OR k.year IS NOT NULL) AS stated FROM n LEFT JOIN k ON n.key = k.key WHERE n.key <> '' GROUP BY n.copy_id)
SELECT copy_id, CASE WHEN c = 0 THEN 'new' WHEN same THEN 'same' WHEN stated THEN 'clash' ELSE 'open' END AS outcome FROM j""",
    "cluster_representatives": rf"""WITH u AS (SELECT DISTINCT {S.base("url")} AS url FROM submissions WHERE {S.base("url")} <> ''), n AS (SELECT url, regexp_extract(url, '/(\d{{4}}/\d{{5}})_', 1) AS k FROM u),
c AS (SELECT url, CASE WHEN k <> '' THEN {S.host("url")} || ':' || k ELSE 'SINGLETON:' || substr(sha1(url), 1, 12) END AS cluster FROM n) SELECT cluster, count(*) AS n, arg_min(url, (length(url), url)) AS representative FROM c GROUP BY 1""",
    "source_alias": f"""WITH l AS (SELECT copy_id, {S.name_key("source")} AS key, source FROM link_copies), b AS (SELECT key, source, count(*) AS n FROM l WHERE key NOT IN ('', 'unknown') GROUP BY 1, 2), m AS (SELECT key, arg_max(source, (n, source)) AS name FROM b GROUP BY 1)
SELECT copy_id, coalesce(name, '') AS source FROM l LEFT JOIN m USING (key)""",
    "question_chunks": r"""WITH s AS (SELECT ocr_id, regexp_replace(coalesce(question, ''), '\n\s*((?:Q(?:uestion)?\.?\s*)?\d{1,2}[.)]\s)', '||\1', 'g') AS t FROM ocr_questions),
c AS (SELECT ocr_id, list_filter(list_transform(regexp_split_to_array(t, '\s*\|\|\s*'), lambda x: trim(x)), lambda x: x <> '') AS c FROM s),
u AS (SELECT ocr_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS chunk_no FROM c)
SELECT ocr_id, chunk_no, chunk, coalesce(nullif(regexp_extract(chunk, '(?i)(\d{1,3})\s*(?:marks?|m)\b', 1), ''), regexp_extract(chunk, '[\[(]\s*(\d{1,2})\s*[\])]\s*$', 1)) AS marks, regexp_extract(chunk, '(?i)(\d{2,3})\s*words?\b', 1) AS words FROM u""",
    "scan_status": """WITH u AS (SELECT unit_key, min(source) AS source, count(*) AS n, count(*) FILTER (salvaged) AS s, coalesce(max(page), 40) AS pages FROM ocr_questions GROUP BY 1)
SELECT source, count(*) AS n_units, sum(n)::BIGINT AS n_questions, sum(s)::BIGINT AS n_salvaged, sum(pages)::BIGINT AS n_pages, sum(ceil(pages / 6))::BIGINT AS n_requests FROM u GROUP BY 1""",
    "interview_search": """WITH d AS (SELECT *, lower(concat_ws(' ', source, paper, lang, year::VARCHAR, series_key)) AS b FROM documents WHERE kind = 'interview_transcript')
SELECT doc_id, year, paper, n_chars FROM d WHERE contains(b, 'interview') AND contains(b, 'gs') ORDER BY year DESC NULLS LAST, doc_id LIMIT 25""",
    "document_facets": " UNION ALL ".join(f"SELECT '{c}' AS facet, {c}::VARCHAR AS value, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY 2" for c in ("lang", "source", "kind", "paper", "year")),
    "optional_search": rf"""SELECT {S.base("url")} AS base, count(*) AS n_rows FROM submissions WHERE lower(trim(subject)) = 'sociology' AND {S.base("url")} <> '' AND regexp_matches(lower(concat_ws(' ', topper, coaching, question)), '(^|[^\p{{L}}\p{{M}}\p{{N}}])migra') GROUP BY 1""",
    "practice_pool": f"""WITH q AS (SELECT {S.paper("subject")} AS paper, {S.norm("question")} AS norm, count(DISTINCT {S.base("url")}) AS n FROM submissions WHERE {S.base("url")} <> '' AND {S.norm("question")} <> '' GROUP BY 1, 2),
t AS (SELECT paper, CASE WHEN count(*) FILTER (n >= 3) >= 20 THEN 3 WHEN count(*) FILTER (n >= 2) >= 10 THEN 2 ELSE 1 END AS least FROM q GROUP BY 1)
SELECT paper, least, count(*) AS pool, max(n) AS most FROM q JOIN t USING (paper) WHERE n >= least GROUP BY 1, 2""",
    "work_shards": """WITH u AS (SELECT unit_key, count(*) AS n FROM ocr_questions WHERE unit_key IS NOT NULL GROUP BY 1), p AS (SELECT n, (row_number() OVER (ORDER BY unit_key) - 1) % 8 AS worker FROM u)
SELECT worker, count(*) AS n_units, sum(n)::BIGINT AS n_questions FROM p GROUP BY 1""",
    "highlighted": r"""SELECT submission_id AS ord, regexp_replace(question, '(?i)(^|[^\p{L}\p{M}\p{N}])(feder)', '\1<mark>\2</mark>', 'g') AS shown FROM submissions WHERE regexp_matches(lower(question), '(^|[^\p{L}\p{M}\p{N}])feder')""",
}
