"""Queries of the index and of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pustaka.functions import text as T
from pustaka.operators import aggregates as A
from pustaka.operators import index as I
from pustaka.operators.ranking import places
from pustaka.plans import sql as S
from pustaka.plans.aggregates import _COPIES
from pustaka.session import cut, kept, read
from pustaka.sources.corpus import source_rows


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word of the documents: in how many it is, the first and last, and the sum of gaps between neighbours, which is what lies between
    the first and the last; so no word's documents have to be sorted."""
    p = I.postings(read(spark, sf_dir, "documents"), "doc_id")
    return p.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), (F.max("doc_id") - F.min("doc_id")).alias("gap_sum"))


def index_bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.postings(read(spark, sf_dir, "documents"), "doc_id")
    per = p.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("n").alias("n_postings"))


def _index(spark: SparkSession, sf_dir: str) -> I.Stored:
    """The stored index of the submissions, built by the first query of an application that asks for it."""

    def make(path: str) -> None:
        rows = source_rows(spark, sf_dir)
        I.build(rows, A.copies(rows), path, sf_dir.rstrip("/").rsplit("/", 1)[-1])

    return I.Stored(spark, kept(spark, f"index of {sf_dir}", make))


def _search(spark: SparkSession, sf_dir: str, **request) -> DataFrame:
    ix, wanted = _index(spark, sf_dir), I.SearchRequest(**request)
    return I.search(ix.questions, ix.refs, ix.copies, wanted, ix.of(wanted.terms))


def search_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, text="migrant famil")


def search_prefix_and_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, text="feder grant", facets={"paper": "GS2"})


def search_exact_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, text="two sides of one coin", mode="exact")


def search_name_text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name and a topic: the name's terms are covered by the person, the topic must be in the copy's questions."""
    return _search(spark, sf_dir, text="hemalata soil")


def search_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, text="discuss", page=2)


def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many copies, names and questions a query finds over all pages."""
    ix, wanted = _index(spark, sf_dir), I.SearchRequest("hemalata soil")
    return I.totals(ix.questions, ix.refs, ix.copies, wanted, ix.of(wanted.terms))


def _view(order: str, text: str, **facets: str):
    def view(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix, wanted = _index(spark, sf_dir), I.SearchRequest(text, facets=facets)
        ranks = read(spark, sf_dir, "toppers").withColumn("key", T.name_key(F.col("topper"))).filter("key <> ''").groupBy("key").agg(A.first_stated("air", "rec_id").alias("air"), A.first_stated("year", "rec_id").alias("year"))
        c = ix.copies.withColumn("key", T.name_key(F.col("topper"))).join(ranks, "key", "left")
        return I.questions_view(ix.questions, ix.refs, c, wanted, order, ix.of(wanted.terms)).drop("qid")

    view.__name__ = f"questions_by_{order}"
    return view


questions_by_year, questions_by_air, questions_by_name, questions_by_refs = _view("year", "feder"), _view("air", "soil"), _view("name", "migra", paper="GS2"), _view("refs", "discuss", paper="GS1")


def index_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build that the tables of the index are of: one for all of them."""
    return _index(spark, sf_dir).stamps().select("n_tables", (F.col("n_tables") == 4).alias("whole"))


def index_vs_scan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index finds against a scan of the texts for the same query: (only_index, only_scan, both)."""
    ix = _index(spark, sf_dir)
    terms = ["soil", "salin"]
    by_index = I.matching(ix.of(terms), terms).withColumn("i", F.lit(1))
    text = F.lower("text")
    by_scan = ix.questions.filter(T.starts_word(text, terms[0]) & T.starts_word(text, terms[1])).select("qid").withColumn("s", F.lit(1))
    j = by_index.join(by_scan, "qid", "full_outer")
    return j.agg(F.count_if(F.col("s").isNull()).alias("only_index"), F.count_if(F.col("i").isNull()).alias("only_scan"), F.count_if(F.col("s").isNotNull() & F.col("i").isNotNull()).alias("both"))


def question_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best answered questions: how many copies answer each, the first 100 by that and by text."""
    ix = _index(spark, sf_dir)
    q, r = ix.questions, ix.refs
    n = r.groupBy("qid").agg(F.count_distinct("base").alias("n_copies"), F.min("base").alias("anchor"))
    return q.join(n, "qid").select("paper", "norm", "n_copies", "anchor").orderBy(F.desc("n_copies"), "norm", "paper").limit(100)


def gap_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the numbers of the texts a word is in, summed up again to those numbers. Numbers are cut into stretches of like length, so
    that the commonest word is gapped and summed in as many tasks; each stretch goes on from the last number before it."""
    p = cut(I.postings(places(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "no"), "no").withColumn("part", F.floor(F.col("no") / STRETCH)), "postings")
    ends = p.groupBy("token", "part").agg(F.max("no").alias("end"))
    before = ends.select("token", "part", F.coalesce(F.max("end").over(Window.partitionBy("token").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    by = Window.partitionBy("token", "part").orderBy("no")
    g = p.join(before, ["token", "part"]).withColumn("gap", F.col("no") - F.coalesce(F.lag("no").over(by), F.col("before")))
    back = g.withColumn("again", F.col("before") + F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return back.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("again") == F.col("no")).alias("n_same"), F.max("gap").alias("max_gap"))


#: Numbers of texts in a stretch of a word's postings.
STRETCH = 1 << 14

QUERIES = {f.__name__: f for f in (search_all_words, search_prefix_and_facet, search_exact_phrase, search_name_text_split, search_second_page, search_totals, questions_by_year, questions_by_air, questions_by_name, questions_by_refs, index_stamps, inverted_index, index_bucket_sizes, index_vs_scan_check, question_refs, gap_decode)}

_TOKENS = f"p AS (SELECT doc_id, unnest(list_distinct({S.tokens('text')})) AS token FROM documents)"
_BUCKET = "list_aggregate(list_transform(list_filter(string_split(substr(token, 1, 2), ''), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '[a-z0-9]') THEN x ELSE '_' || lower(hex(unicode(x))) END), 'string_agg', '')"


def _start(text: str, term: str) -> str:
    return rf"regexp_matches({text}, '(^|[^\p{{L}}\p{{M}}\p{{N}}]){term}')"


def _found(where: str, facet: str = "", page: int = 1) -> str:
    """A search as a scan of the texts. Terms of the query are `where`, over the lower-case text lc; no name holds any of them."""
    texts = f"""q AS (SELECT paper, norm, arg_max(question, (length(question), -ord)) AS text FROM (SELECT *, {S.norm("question")} AS norm FROM src) WHERE norm <> '' GROUP BY paper, norm),
r AS (SELECT DISTINCT paper, {S.norm("question")} AS norm, base FROM src WHERE base <> ''),
c AS (SELECT * FROM copies WHERE true {facet}),
m AS (SELECT base, {where} AS hit FROM (SELECT r.base, lower(q.text) AS lc FROM q JOIN r USING (paper, norm)))"""
    return _COPIES + ", " + texts + f""", h AS (SELECT base, count(*) AS n_hits FROM m WHERE hit GROUP BY base),
f AS (SELECT c.base, c.topper, c.paper, n_hits AS score, n_hits FROM c JOIN h USING (base)),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, topper NULLS FIRST, paper, base) AS place FROM f)
SELECT base, topper, paper, score, n_hits, place::INT AS place FROM o WHERE place > {25 * (page - 1)} AND place <= {25 * page}"""


_SPLIT = (
    _COPIES
    + f""", q AS (SELECT paper, norm, arg_max(question, (length(question), -ord)) AS text FROM (SELECT *, {S.norm("question")} AS norm FROM src) WHERE norm <> '' GROUP BY paper, norm),
r AS (SELECT DISTINCT paper, {S.norm("question")} AS norm, base FROM src WHERE base <> ''),
c AS (SELECT *, {_start("lower(coalesce(topper, ''))", "hemalata")} AS n1, {_start("lower(coalesce(topper, ''))", "soil")} AS n2 FROM copies),
t AS (SELECT r.base, {_start("lower(q.text)", "hemalata")} AS t1, {_start("lower(q.text)", "soil")} AS t2 FROM q JOIN r USING (paper, norm)),
h AS (SELECT base, count(*) FILTER (t1 AND t2) AS h12, count(*) FILTER (t1) AS h1, count(*) FILTER (t2) AS h2 FROM t GROUP BY base),
f AS (SELECT c.base, topper, paper, CASE WHEN n1 AND n2 THEN 0 WHEN n1 THEN h2 WHEN n2 THEN h1 ELSE h12 END AS n_hits, n1 OR n2 AS named, n1 AND n2 AS all_named FROM c LEFT JOIN h USING (base)),
s AS (SELECT base, topper, paper, CASE WHEN named THEN 1000000 ELSE 0 END + n_hits AS score, n_hits FROM f WHERE n_hits > 0 OR all_named),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, topper NULLS FIRST, paper, base) AS place FROM s)
SELECT base, topper, paper, score, n_hits, place::INT AS place FROM o WHERE place <= 25"""
)

#: By tokens against by text, each found in its own way.
_CHECK = f""", k AS (SELECT paper, norm, unnest({S.tokens("lc")}) AS token FROM q), a AS (SELECT paper, norm FROM k GROUP BY 1, 2 HAVING bool_or(starts_with(token, 'soil')) AND bool_or(starts_with(token, 'salin'))),
b AS (SELECT paper, norm FROM q WHERE {_start("lc", "soil")} AND {_start("lc", "salin")})
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_index, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_scan, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both"""


def _view_sql(where: str, order: str, facet: str = "") -> str:
    return _COPIES + f""", q AS (SELECT paper, norm, arg_max(question, (length(question), -ord)) AS text FROM (SELECT *, {S.norm("question")} AS norm FROM src) WHERE norm <> '' GROUP BY paper, norm),
r AS (SELECT DISTINCT paper, {S.norm("question")} AS norm, base FROM src WHERE base <> ''),
p AS (SELECT {S.name_key("topper")} AS key, arg_min(air, rec_id) FILTER (air IS NOT NULL) AS air, arg_min(year, rec_id) FILTER (year IS NOT NULL) AS year FROM toppers WHERE {S.name_key("topper")} <> '' GROUP BY 1),
c AS (SELECT base, coalesce(nullif(air, 0), 1000000000) AS air, coalesce(year, 0) AS year FROM copies LEFT JOIN p ON {S.name_key("copies.topper")} = p.key WHERE true {facet}),
n AS (SELECT q.paper, q.text, count(*) AS n_refs, min(c.air) AS best, max(c.year) AS newest FROM q JOIN r USING (paper, norm) JOIN c USING (base) WHERE {where.replace("lc", "lower(q.text)")} GROUP BY q.paper, q.norm, q.text)
SELECT *, row_number() OVER (ORDER BY {order} text, paper)::INT AS place FROM n QUALIFY place <= 25"""


ORACLE = {
    "search_totals": _SPLIT.split(",\no AS (SELECT")[0] + " SELECT count(*) AS n_copies, count(*) FILTER (score >= 1000000) AS n_named, coalesce(sum(n_hits), 0)::BIGINT AS n_questions FROM s",
    "questions_by_year": _view_sql(_start("lc", "feder"), "newest DESC, best,"),
    "questions_by_air": _view_sql(_start("lc", "soil"), "best, n_refs DESC,"),
    "questions_by_name": _view_sql(_start("lc", "migra"), "", "AND copies.paper = 'GS2'"),
    "questions_by_refs": _view_sql(_start("lc", "discuss"), "n_refs DESC,", "AND copies.paper = 'GS1'"),
    "index_stamps": "SELECT 4 AS n_tables, true AS whole",
    "search_all_words": _found(_start("lc", "migrant") + " AND " + _start("lc", "famil")),
    "search_prefix_and_facet": _found(_start("lc", "feder") + " AND " + _start("lc", "grant"), facet="AND paper = 'GS2'"),
    "search_exact_phrase": _found(r"contains(' ' || array_to_string(regexp_extract_all(lc, '[\p{L}\p{M}\p{N}]+'), ' '), ' two sides of one coin')"),
    "search_name_text_split": _SPLIT,
    "search_second_page": _found(_start("lc", "discuss"), page=2),
    "inverted_index": f"""WITH {_TOKENS}, g AS (SELECT token, doc_id, doc_id - lag(doc_id) OVER (PARTITION BY token ORDER BY doc_id) AS gap FROM p)
SELECT token, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc, coalesce(sum(gap), 0)::BIGINT AS gap_sum FROM g GROUP BY token""",
    "index_bucket_sizes": f"WITH {_TOKENS}, t AS (SELECT token, count(*) AS n, {_BUCKET} AS bucket FROM p GROUP BY token) SELECT bucket, count(*) AS n_tokens, sum(n)::BIGINT AS n_postings FROM t GROUP BY bucket",
    "index_vs_scan_check": _COPIES
    + f""", q AS (SELECT paper, norm, lower(arg_max(question, (length(question), -ord))) AS lc FROM (SELECT *, {S.norm("question")} AS norm FROM src) WHERE norm <> '' GROUP BY paper, norm)
{_CHECK}""",
    "question_refs": _COPIES
    + f""", r AS (SELECT paper, {S.norm("question")} AS norm, base FROM src WHERE base <> '') SELECT paper, norm, count(DISTINCT base) AS n_copies, min(base) AS anchor FROM r WHERE norm <> '' GROUP BY ALL ORDER BY 3 DESC, 2, 1 LIMIT 100""",
    "gap_decode": f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS no, text FROM documents), p AS (SELECT no, unnest(list_distinct({S.tokens("text")})) AS token FROM d),
g AS (SELECT token, no - coalesce(lag(no) OVER (PARTITION BY token ORDER BY no), 0) AS gap, {_BUCKET} AS bucket FROM p) SELECT bucket, count(*) AS n, count(*) AS n_same, max(gap) AS max_gap FROM g GROUP BY bucket""",
}
