"""Queries of the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.functions import pages as P
from pustaka.functions import text as T
from pustaka.operators import aggregates as A
from pustaka.operators import dedupe as D
from pustaka.operators.checks import all_of, invariant, overlap_with_first
from pustaka.plans import sql as S
from pustaka.plans.aggregates import _COPIES
from pustaka.plans.scalars import _IDS
from pustaka.plans.search import _index as stored_index
from pustaka.session import read
from pustaka.sources.corpus import source_rows


def cross_copy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each provenance's questions per paper against those of the first provenance; below 0.6 they disagree."""
    w = source_rows(spark, sf_dir).filter("prov IS NOT NULL").select("paper", "prov", F.explode(F.split(T.norm(F.col("question")), " ")).alias("word")).filter("word <> ''")
    o = overlap_with_first(w, "paper", "prov", "word")
    return o.select("paper", "prov", "n", "common", F.round("overlap", 6).alias("overlap"), (F.col("overlap") >= 0.6).alias("agrees"))


def words_of_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word the texts that the stored index gives for it, and those that hold it: (token, n_index, n_text)."""
    ix = stored_index(spark, sf_dir)
    made = ix.all.groupBy("token").agg(F.count(F.lit(1)).alias("n_index"))
    seen = ix.questions.select(F.explode(F.array_distinct(T.index_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n_text"))
    return made.join(seen, "token", "full_outer").na.fill(0)


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_rows(spark, sf_dir)
    raw = read(spark, sf_dir, "submissions")
    copies = A.copies(rows)
    ids = copies.select(T.copy_id(F.col("base")).alias("id"), "base").groupBy("id").agg(F.count_distinct("base").alias("n"))
    exact = D.exact(rows)
    n_text = rows.filter(T.norm(F.col("question")) != "").agg(F.count(F.lit(1)).alias("n"))
    refs = exact.agg(F.coalesce(F.sum("n_refs"), F.lit(0)).alias("m"))
    moves = rows.filter(F.col("base").endswith("_copy.pdf")).select(F.col("base").alias("old"), T.slug(F.col("base")).alias("new")).distinct()
    lead = P.lead_length(F.col("text"))
    labels = read(spark, sf_dir, "ocr_labels").join(read(spark, sf_dir, "ocr_questions").select("ocr_id", F.lit(True).alias("known")), "ocr_id", "left")
    return all_of(
        [
            invariant("submission ids are unique", raw.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1),
            invariant("urls are http or https", raw, ~F.trim("url").rlike("(?i)^https?://")),
            invariant("copy ids do not collide", ids, F.col("n") > 1),
            invariant("merging loses no reference", n_text.withColumn("k", F.lit(1)).join(refs.withColumn("k", F.lit(1)), "k"), F.col("n") != F.col("m")),
            invariant("labels name a scanned question", labels, F.col("known").isNull()),
            invariant("ranks are in range", read(spark, sf_dir, "toppers"), ~F.col("air").between(1, 1100)),
            invariant("targets sum to one", read(spark, sf_dir, "source_targets").agg(F.sum("target_share").alias("s")), F.abs(F.col("s") - 1) > 1e-9),
            invariant("lengths are those of the texts", read(spark, sf_dir, "documents"), F.length("text") != F.col("n_chars")),
            invariant("links are listed once", read(spark, sf_dir, "link_copies").groupBy(T.url_base(F.col("url")).alias("base")).agg(F.count(F.lit(1)).alias("n")), (F.col("n") > 1) & (F.col("base") != "")),
            invariant("references lead to a copy", rows.filter("base <> ''").select("base").distinct().join(copies.select("base", F.lit(True).alias("known")), "base", "left"), F.col("known").isNull()),
            invariant("interviews have a text", read(spark, sf_dir, "documents").filter("kind = 'interview_transcript'"), F.trim("text") == ""),
            invariant("moved addresses are another's only once", moves.groupBy("new").agg(F.count_distinct("old").alias("n")), F.col("n") > 1),
            invariant("leads and tails are the texts", read(spark, sf_dir, "documents").filter(F.length("text") > 500), F.concat(F.substring(F.col("text"), F.lit(1), lead), F.substring(F.col("text"), lead + 1, F.length("text"))) != F.col("text")),
            invariant("the index holds the words of its texts", words_of_index(spark, sf_dir), F.col("n_index") != F.col("n_text")),
            invariant("booklets have one source", read(spark, sf_dir, "ocr_questions").groupBy("unit_key").agg(F.count_distinct("source").alias("n")), F.col("n") > 1),
        ]
    )


QUERIES = {f.__name__: f for f in (cross_copy_overlap, invariants)}

ORACLE = {
    "cross_copy_overlap": _COPIES
    + f""", w AS (SELECT DISTINCT paper, prov, unnest(string_split({S.norm("question")}, ' ')) AS word FROM src WHERE prov IS NOT NULL), k AS (SELECT * FROM w WHERE word <> ''), f AS (SELECT paper, min(prov) AS first FROM k GROUP BY 1),
b AS (SELECT paper, word FROM k JOIN f USING (paper) WHERE prov = first), s AS (SELECT paper, prov, count(*) AS n FROM k GROUP BY 1, 2), c AS (SELECT paper, prov, count(*) AS common FROM k JOIN b USING (paper, word) GROUP BY 1, 2), bs AS (SELECT paper, count(*) AS nf FROM b GROUP BY 1)
SELECT paper, prov, n, coalesce(common, 0) AS common, round(coalesce(common, 0) / least(n, nf), 6) AS overlap, coalesce(common, 0) / least(n, nf) >= 0.6 AS agrees FROM s JOIN f USING (paper) JOIN bs USING (paper) LEFT JOIN c USING (paper, prov) WHERE prov <> first""",
    "invariants": f"""{_COPIES}, {_IDS}, nq AS (SELECT paper, {S.norm("question")} AS norm, question, ord FROM src), qt AS (SELECT paper, norm, arg_max(question, (length(question), -ord)) AS text, count(*) AS n FROM nq WHERE norm <> '' GROUP BY 1, 2),
ws AS (SELECT token, count(*) AS n FROM (SELECT paper, norm, unnest(list_distinct({S.tokens("text")})) AS token FROM qt) GROUP BY 1), wu AS (SELECT token, count(DISTINCT (paper, norm)) AS n FROM (SELECT paper, norm, unnest({S.tokens("text")}) AS token FROM qt) GROUP BY 1),
dl AS (SELECT text, CASE WHEN contains(substr(text, 1, 251), ' ') AND length(substr(text, 1, 251)) - instr(reverse(substr(text, 1, 251)), ' ') >= 150 THEN length(substr(text, 1, 251)) - instr(reverse(substr(text, 1, 251)), ' ') ELSE 250 END AS cut FROM documents WHERE length(text) > 500),
c AS (
SELECT 'submission ids are unique' AS id, (SELECT count(*) FROM (SELECT submission_id FROM submissions GROUP BY 1 HAVING count(*) > 1)) AS bad_count
UNION ALL SELECT 'urls are http or https', count(*) FILTER (NOT regexp_matches(trim(url), '(?i)^https?://')) FROM submissions
UNION ALL SELECT 'copy ids do not collide', (SELECT count(*) FROM (SELECT copy_id FROM i GROUP BY 1 HAVING count(DISTINCT base) > 1))
UNION ALL SELECT 'merging loses no reference', ((SELECT count(*) FROM nq WHERE norm <> '') <> (SELECT sum(n) FROM qt))::INT
UNION ALL SELECT 'labels name a scanned question', count(*) FROM ocr_labels WHERE ocr_id NOT IN (SELECT ocr_id FROM ocr_questions)
UNION ALL SELECT 'ranks are in range', count(*) FILTER (air NOT BETWEEN 1 AND 1100) FROM toppers
UNION ALL SELECT 'targets sum to one', (SELECT (abs(sum(target_share) - 1) > 1e-9)::INT FROM source_targets)
UNION ALL SELECT 'lengths are those of the texts', count(*) FILTER (length(text) <> n_chars) FROM documents
UNION ALL SELECT 'links are listed once', (SELECT count(*) FROM (SELECT {S.base("url")} AS base FROM link_copies WHERE {S.base("url")} <> '' GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'references lead to a copy', (SELECT count(*) FROM (SELECT DISTINCT base FROM src WHERE base <> '' EXCEPT SELECT base FROM copies))
UNION ALL SELECT 'interviews have a text', count(*) FILTER (trim(text) = '') FROM documents WHERE kind = 'interview_transcript'
UNION ALL SELECT 'moved addresses are another''s only once', (SELECT count(*) FROM (SELECT {S.slug("base")} FROM (SELECT DISTINCT base FROM src WHERE ends_with(base, '_copy.pdf')) GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'leads and tails are the texts', count(*) FILTER (substr(text, 1, cut) || substr(text, cut + 1) <> text) FROM dl
UNION ALL SELECT 'the index holds the words of its texts', (SELECT count(*) FROM ws FULL JOIN wu USING (token) WHERE ws.n IS DISTINCT FROM wu.n)
UNION ALL SELECT 'booklets have one source', (SELECT count(*) FROM (SELECT unit_key FROM ocr_questions GROUP BY 1 HAVING count(DISTINCT source) > 1)))
SELECT id, bad_count = 0 AS ok, bad_count FROM c""",
}
