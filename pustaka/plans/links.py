"""Queries of links and copies: where they lead, what is to be done about them, and how lists of them are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.functions import names as N
from pustaka.functions import text as T
from pustaka.operators import aggregates as A
from pustaka.operators import entities as E
from pustaka.operators import joins as J
from pustaka.operators.ranking import unique_slugs
from pustaka.plans import sql as S
from pustaka.plans.aggregates import _COPIES
from pustaka.plans.core_data import ORACLE as CORE_SQL
from pustaka.session import read
from pustaka.sources.corpus import source_rows
from pustaka.sources.csv_records import parse_records, typed


def _first_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each address in the list of links, as a manifest of files: (base, host, status, tries, origin, key, bytes, saved, stored)."""
    lc = read(spark, sf_dir, "link_copies").withColumn("base", T.url_base(F.col("url"))).filter("base <> ''")
    one = lc.groupBy("base").agg(F.min_by(F.struct("verified", "year", "air", "note", "source", "added_by"), "copy_id").alias("e")).select("base", "e.*")
    return one.select(
        "base",
        T.url_host(F.col("base")).alias("host"),
        F.when(F.col("verified"), "ok").when(F.col("verified").isNull(), "pending").when(F.col("added_by") == "form", "gone").otherwise("failed").alias("status"),
        F.when(F.col("year").isNull(), 3).otherwise(F.col("year") % 3).alias("tries"),
        F.when(F.col("air").isNull(), "down").otherwise("up").alias("origin"),
        F.sha2("base", 256).alias("key"),
        (F.length("base") * 1000).cast("long").alias("bytes"),
        F.col("note").isNull().alias("saved"),
        F.col("source").isNotNull().alias("stored"),
        F.coalesce(F.col("added_by") == "maintainer", F.lit(False)).alias("issue"),
    )


def due_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files wait to be fetched, and why."""
    why = F.when(F.col("status") == "pending", "pending").when((F.col("status") == "failed") & (F.col("tries") < 3), "retry").otherwise("not due")
    return _first_links(spark, sf_dir).groupBy("status", why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _trouble() -> Column:
    s = F.col("status")
    return F.when((s == "ok") & (F.col("origin") == "down"), "down").when(s == "gone", "gone").when((s == "failed") & (F.col("tries") >= 3), "failed").otherwise("")


def issue_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in trouble without an open issue, and open issues of links that are well again."""
    m = _first_links(spark, sf_dir).withColumn("trouble", _trouble()).withColumn("marker", F.substring(F.sha1("base"), 1, 16))
    do = F.when((F.col("trouble") != "") & ~F.col("issue"), "open").when((F.col("trouble") == "") & F.col("issue"), "close")
    return m.select("base", "marker", "trouble", do.alias("action")).filter("action IS NOT NULL")


def release_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that may be released to their publisher's address, and what keeps the others back; the first reason counts."""
    m = _first_links(spark, sf_dir).filter("status = 'ok'")
    why = F.when(F.col("origin") != "up", "link not confirmed up").when(~F.col("saved"), "not saved yet").when(~F.col("stored"), "not in the bucket").otherwise("released")
    return m.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("n_bytes"))


def stored_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by host and status, and the bytes of different keys."""
    m = _first_links(spark, sf_dir)
    keys = m.filter("status = 'ok'").groupBy("host", "key").agg(F.max("bytes").alias("b")).groupBy("host").agg(F.sum("b").alias("stored_bytes"))
    return m.groupBy("host", "status").agg(F.count(F.lit(1)).alias("n")).join(keys, "host", "left").na.fill(0, ["stored_bytes"])


def url_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose copy is down lead to its stored file or its archived page; the fragment stays."""
    state = A.copies(source_rows(spark, sf_dir)).select("base", (F.col("prov") == "mixed").alias("down"), (F.col("n_rows") >= 3).alias("ok"), F.col("coaching").isNotNull().alias("archived"))
    s = read(spark, sf_dir, "submissions").select("submission_id", "url", T.url_base(F.col("url")).alias("base"))
    to = F.when(F.col("down") & F.col("ok"), F.concat(F.lit("https://stored.example/"), F.sha2("base", 256), F.lit(".pdf"))).when(F.col("down") & F.col("archived"), F.concat(F.lit("https://archived.example/"), F.col("base"))).otherwise(F.col("base"))
    tail = F.when(T.url_fragment(F.col("url")) != "", F.concat(F.lit("#"), T.url_fragment(F.col("url")))).otherwise("")
    return s.join(state, "base", "left").select("submission_id", F.concat(to, tail).alias("url"))


def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a link is fetched from: where it has moved, a file of a file service, or as it is."""
    lc = read(spark, sf_dir, "link_copies").select("copy_id", F.trim(T.blank(F.col("url"))).alias("u"), "verified")
    moves = lc.filter("NOT verified AND u <> ''").select(T.url_base(F.col("u")).alias("old"), F.concat(F.lit("https://moved.example/"), F.sha1("u")).alias("new")).distinct()
    both = lc.union(lc.filter("verified").select((-F.col("copy_id")).alias("copy_id"), F.concat(F.lit("https://drive.google.com/file/d/"), F.sha1("u"), F.lit("/view")).alias("u"), "verified"))
    moved = J.rewrite(both, T.url_base(F.col("u")), moves)
    return moved.select("copy_id", *J.fetched_from(F.col("u"), F.col("moved")))


def capture_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per copy the latest time at which the text of its first row was received for it."""
    s = read(spark, sf_dir, "submissions").select("submission_id", T.url_base(F.col("url")).alias("base"), F.md5(T.norm(F.col("question"))).alias("digest"), "received_at").filter("base <> ''")
    wanted = s.groupBy("base").agg(F.min_by("digest", "submission_id").alias("digest"))
    return s.join(wanted, ["base", "digest"]).groupBy("base").agg(F.max("received_at").alias("captured_at"), F.count(F.lit(1)).alias("n"))


def _corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and scanned booklets as one list: (base, kind, paper, person)."""
    lc = read(spark, sf_dir, "link_copies").select(T.url_base(F.col("url")).alias("base"), F.lit("link").alias("kind"), T.paper_of(F.col("paper")).alias("paper"), T.name_key(F.col("topper")).alias("person"))
    oc = read(spark, sf_dir, "ocr_questions").select(T.url_base(F.col("url")).alias("base"), F.lit("scan").alias("kind"), T.paper_of(F.col("paper")).alias("paper"), T.name_key(F.regexp_replace(N.file_person(F.col("url")), "-", " ")).alias("person"))
    return lc.unionByName(oc).filter("base <> ''").distinct()


def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_union(spark, sf_dir)


def work_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be read: all that is not searchable, and what is to be read again."""
    searchable = source_rows(spark, sf_dir).filter("base <> ''").select("base").distinct()
    redo = read(spark, sf_dir, "ocr_questions").filter("salvaged").select(T.url_base(F.col("url")).alias("base")).distinct()
    c = _corpus_union(spark, sf_dir).filter("kind = 'link'").select("base").union(_corpus_union(spark, sf_dir).filter("kind = 'scan'").join(redo, "base", "left_semi").select("base")).distinct()
    return c.join(searchable, "base", "left_anti").withColumn("why", F.lit("new")).union(redo.withColumn("why", F.lit("redo")))


def optional_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries for optional subjects with the reason they are taken or not, and how many of their questions are not blank."""
    e = read(spark, sf_dir, "ocr_questions").filter(T.paper_of(F.col("paper")) == "Optional").groupBy("unit_key").agg(F.min(T.url_base(F.col("url"))).alias("base"), F.min("paper").alias("subject"), F.count_if(F.trim("question") != "").alias("n_questions"), F.min("ocr_id").alias("ord"))
    first = e.groupBy("base").agg(F.min("ord").alias("first"))
    j = e.join(first, "base", "left")
    why = F.when((F.coalesce("base", F.lit("")) == "") | (F.coalesce(F.trim("subject"), F.lit("")) == ""), "lacks a field").when(F.col("ord") > F.col("first"), "conflict").otherwise("taken")
    return j.select("unit_key", "n_questions", why.alias("reason"))


def link_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a person and paper for which a scanned optional copy exists: the conflict, or taken."""
    lc = read(spark, sf_dir, "link_copies").select("copy_id", T.name_key(F.col("topper")).alias("person"), T.paper_of(F.col("paper")).alias("paper"))
    opt = _corpus_union(spark, sf_dir).filter("kind = 'scan' AND paper = 'Optional'").select("person").distinct().withColumn("known", F.lit(True))
    j = lc.join(opt, "person", "left")
    return j.select("copy_id", F.when(F.col("known") & (F.col("paper") != "Optional"), "clash of papers").when(F.col("known"), "optional").otherwise("taken").alias("reason"))


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sources of questions under one another, each with its provenance, without what is denied, and at the addresses they have moved to."""
    cols = ["src", "ord", "topper", "question", "url", "prov"]
    a = read(spark, sf_dir, "submissions").select(F.lit("submissions").alias("src"), F.col("submission_id").alias("ord"), "topper", "question", "url", "prov")
    b = typed(parse_records(read(spark, sf_dir, "submission_lines"))).select(F.lit("lines").alias("src"), F.col("record_id").alias("ord"), "topper", "question", "url", F.lit("community").alias("prov"))
    c = read(spark, sf_dir, "ocr_questions").filter("NOT salvaged").select(F.lit("scans").alias("src"), F.col("ocr_id").alias("ord"), F.lit(None).cast("string").alias("topper"), "question", "url", F.lit("ocr").alias("prov"))
    rows = a.unionByName(b).unionByName(c).withColumn("qkey", T.q_key(F.col("question"))).withColumn("base", T.url_base(F.col("url")))
    keys = read(spark, sf_dir, "ocr_questions").filter("salvaged").select(T.q_key(F.col("question")).alias("qkey"))
    urls = read(spark, sf_dir, "link_copies").select(T.url_base(F.col("url")).alias("base"))
    kept = J.without(J.without(rows, keys, ["qkey"]), urls, ["base"])
    moves = rows.filter(F.col("base").endswith("_copy.pdf")).select(F.col("base").alias("old"), F.concat(F.lit("https://moved.example/"), T.slug(F.col("base"))).alias("new")).distinct()
    frag = T.url_fragment(F.col("url"))
    tail = F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise("")
    return J.rewrite(kept, F.col("base"), moves).withColumn("url", F.concat(F.coalesce("moved", "base"), tail)).select(*cols)


def positional_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a person paired with the files of a new listing by place, with the six ways in which that ends."""
    old = source_rows(spark, sf_dir).filter("base <> ''").select(T.name_key(F.col("topper")).alias("person"), F.col("base").alias("old_url"), N.file_year(F.col("base")).alias("old_year")).filter("person <> ''").distinct()
    new = read(spark, sf_dir, "link_copies").select(T.name_key(F.col("topper")).alias("person"), T.url_base(F.col("url")).alias("new_url"), F.col("year").alias("new_year"), F.coalesce("verified", F.lit(False)).alias("available"))
    new = new.filter("person <> ''").groupBy("person", "new_url").agg(F.min("new_year").alias("new_year"), F.max("available").alias("available"))
    return J.outcomes(old, new, ["person"], "old_url", "new_url").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def redo_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies to be read again, each through the one that stands for its cluster; one that has moved stands before any other."""
    urls = source_rows(spark, sf_dir).filter("base <> ''").select(F.col("base").alias("url")).distinct()
    c = E.clusters(urls).withColumn("moved", F.col("url").rlike("_gs[1-4]"))
    rep = c.groupBy("cluster").agg(F.min_by("url", F.struct((~F.col("moved")).alias("m"), F.length("url"), "url")).alias("representative"))
    redo = source_rows(spark, sf_dir).filter("prov = 'ocr' AND base <> ''").select(F.col("base").alias("url")).distinct()
    return redo.join(c, "url", "left").join(rep, "cluster", "left").select(F.coalesce("representative", "url").alias("url")).distinct()


def publisher_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per publisher the addresses of all lists, the tests they are of, how many of these have several, and how far that shortens the work."""
    lists = [read(spark, sf_dir, t).select(T.url_base(F.col("url")).alias("url")) for t in ("submissions", "link_copies", "ocr_questions")]
    c = E.clusters(lists[0].union(lists[1]).union(lists[2]).filter("url <> ''").distinct(), E.TEST_NUMBERS)
    g = c.groupBy(T.url_host(F.col("url")).alias("host"), "cluster").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("host").agg(F.sum("n").alias("n_urls"), F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.startswith("cluster", F.lit("SINGLETON:"))).alias("n_single"), F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("saved"))


def cluster_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned questions of booklets that are not flagged, by booklet; one with a salvaged question is."""
    q = read(spark, sf_dir, "ocr_questions").filter("unit_key IS NOT NULL")
    flagged = q.filter("salvaged").select("unit_key").distinct()
    members = q.select("unit_key", "url").distinct()
    return q.join(members, ["unit_key", "url"]).join(flagged, "unit_key", "left_anti").groupBy("unit_key").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first_page"))


def optional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions added to those a booklet has: new ones only where no earlier one begins alike, in the order of rows."""
    q = read(spark, sf_dir, "ocr_questions").filter("unit_key IS NOT NULL").select("unit_key", "ocr_id", "salvaged", N.short_key(F.col("question"), 64).alias("key")).filter("key <> ''")
    best = q.groupBy("unit_key", "key").agg(F.min_by("salvaged", F.struct(F.coalesce(F.col("salvaged"), F.lit(False)).alias("s"), "ocr_id")).alias("added"))
    return best.groupBy("unit_key").agg(F.count_if(~F.coalesce("added", F.lit(False))).alias("n_prior"), F.count_if(F.coalesce("added", F.lit(False))).alias("n_added"))


def copies_with_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy with the address of its person's page."""
    c = A.copies(source_rows(spark, sf_dir)).select("base", "topper", "paper")
    names = c.filter("topper IS NOT NULL").groupBy("topper").agg(F.min("base").alias("ord")).withColumn("slug", T.slug(F.col("topper")))
    return c.join(unique_slugs(names, "slug", "ord").select("topper", "unique_slug"), "topper", "left").select("base", "topper", "unique_slug")


def refs_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per paper the references to copies, how many lead to one whose person is known, and whether so few do that the index is stale."""
    r = source_rows(spark, sf_dir).filter("base <> ''").select("paper", T.norm(F.col("question")).alias("norm"), "base").distinct()
    known = A.copies(source_rows(spark, sf_dir)).filter("topper IS NOT NULL AND topper <> 'Unknown'").select("base", F.lit(True).alias("known"))
    g = r.join(known, "base", "left").groupBy("paper").agg(F.count(F.lit(1)).alias("n_refs"), F.count("known").alias("n_known"))
    return g.withColumn("stale", F.col("n_known") < 0.5 * F.col("n_refs"))


def interview_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of interviews with the length of each transcript, 0 where there is none."""
    listed = read(spark, sf_dir, "documents").filter("kind = 'interview_transcript'").select("doc_id", "year", "source")
    texts = read(spark, sf_dir, "documents").filter("kind = 'interview_transcript' AND trim(text) <> ''").select("doc_id", F.length("text").alias("n_chars"))
    return listed.join(texts, "doc_id", "left").na.fill(0, ["n_chars"])


def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booklets that need another reading: those to be read again, or read without a find, if they had no error and need no hand."""
    u = read(spark, sf_dir, "ocr_questions").filter("unit_key IS NOT NULL").groupBy("unit_key").agg(
        F.bool_or(F.coalesce("salvaged", F.lit(False))).alias("redo"), F.bool_or(F.col("marks").isNotNull()).alias("hit"), F.bool_or(F.col("question").isNull()).alias("error"), F.bool_or(F.col("page").isNull()).alias("manual")
    )
    return u.filter((F.col("redo") | ~F.col("hit")) & ~F.col("error") & ~F.col("manual")).select("unit_key", "redo", "hit")


def routed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted links by what becomes of them: an override of a known person, a row of an optional subject, a new link, or rejected with the reason."""
    lc = read(spark, sf_dir, "link_copies").select("copy_id", T.name_key(F.col("topper")).alias("key"), T.url_base(F.col("url")).alias("base"), "air", "year", T.paper_of(F.col("paper")).alias("paper"))
    known = read(spark, sf_dir, "toppers").select(T.name_key(F.col("topper")).alias("key")).filter("key <> ''").distinct().withColumn("known", F.lit(True))
    j = lc.join(known, "key", "left")
    reject = F.when(F.col("key").isin("", "unknown"), "no name").when(~F.coalesce(F.col("air").between(1, 1100), F.lit(True)), "rank out of range").when(~F.coalesce(F.col("year").between(2013, 2030), F.lit(True)), "year out of range").when(F.col("base") == "", "no address")
    to = F.when(reject.isNotNull(), "rejected").when(F.col("known") & F.col("air").isNotNull(), "override").when(F.col("paper") == "Optional", "optional").otherwise("link")
    return j.select("copy_id", to.alias("route"), reject.alias("reason"))


QUERIES = {
    f.__name__: f
    for f in (
        due_links, issue_actions, release_reasons, stored_usage, url_substitution, link_resolve, capture_latest, corpus_union, work_corpus, optional_admission, link_conflicts, source_union,
        positional_outcomes, redo_representatives, publisher_clusters, cluster_records, optional_merge, copies_with_slugs, refs_resolved, interview_texts, work_list, routed_upsert,
    )
}

_M = f"""WITH f AS (SELECT *, {S.base("url")} AS base FROM link_copies), o AS (SELECT * FROM f WHERE base <> '' QUALIFY row_number() OVER (PARTITION BY base ORDER BY copy_id) = 1),
m AS (SELECT base, {S.host("base")} AS host, CASE WHEN verified THEN 'ok' WHEN verified IS NULL THEN 'pending' WHEN added_by = 'form' THEN 'gone' ELSE 'failed' END AS status, CASE WHEN year IS NULL THEN 3 ELSE year % 3 END AS tries,
  CASE WHEN air IS NULL THEN 'down' ELSE 'up' END AS origin, sha256(base) AS key, length(base) * 1000 AS bytes, note IS NULL AS saved, source IS NOT NULL AS stored, coalesce(added_by = 'maintainer', false) AS issue FROM o)"""
_TROUBLE = "CASE WHEN status = 'ok' AND origin = 'down' THEN 'down' WHEN status = 'gone' THEN 'gone' WHEN status = 'failed' AND tries >= 3 THEN 'failed' ELSE '' END"
_FRAG = "CASE WHEN contains(url, '#') AND regexp_replace(trim(url), '^[^#]*#', '') <> '' THEN '#' || regexp_replace(trim(url), '^[^#]*#', '') ELSE '' END"
_YEAR = lambda c: rf"try_cast(regexp_extract(split_part({S.base(c)}, '/', -1), '(?:^|\D)(20(?:1[5-9]|2[0-6]))(?:\D|$)', 1) AS INT)"
_PERSON = rf"regexp_replace(regexp_extract(split_part({S.base('url')}, '/', -1), '(?i)^\d+[_-](.*?)\.pdf$', 1), '[_-]+(?:rank.*|air.*|\d.*)$', '', 'i')"
_UNION = f"""u AS (SELECT DISTINCT * FROM (SELECT {S.base("url")} AS base, 'link' AS kind, {S.paper("paper")} AS paper, {S.name_key("topper")} AS person FROM link_copies
  UNION ALL SELECT {S.base("url")}, 'scan', {S.paper("paper")}, {S.name_key(f"replace({_PERSON}, '-', ' ')")} FROM ocr_questions) WHERE base <> '')"""
_LINES = CORE_SQL["p1_loaded"]
_SHORT64 = "substr(regexp_replace(lower(coalesce(question, '')), '[^a-z0-9]', '', 'g'), 1, 64)"

ORACLE = {
    "due_links": _M + " SELECT status, CASE WHEN status = 'pending' THEN 'pending' WHEN status = 'failed' AND tries < 3 THEN 'retry' ELSE 'not due' END AS reason, count(*) AS n FROM m GROUP BY 1, 2",
    "issue_actions": _M + f""", t AS (SELECT *, {_TROUBLE} AS trouble FROM m) SELECT base, substr(sha1(base), 1, 16) AS marker, trouble, CASE WHEN trouble <> '' THEN 'open' ELSE 'close' END AS action FROM t WHERE (trouble <> '') <> issue""",
    "release_reasons": _M + """ SELECT CASE WHEN origin <> 'up' THEN 'link not confirmed up' WHEN NOT saved THEN 'not saved yet' WHEN NOT stored THEN 'not in the bucket' ELSE 'released' END AS reason, count(*) AS n, sum(bytes)::BIGINT AS n_bytes FROM m WHERE status = 'ok' GROUP BY 1""",
    "stored_usage": _M + """, k AS (SELECT host, sum(b)::BIGINT AS stored_bytes FROM (SELECT host, key, max(bytes) AS b FROM m WHERE status = 'ok' GROUP BY 1, 2) GROUP BY 1)
SELECT m.host, status, count(*) AS n, coalesce(any_value(stored_bytes), 0) AS stored_bytes FROM m LEFT JOIN k USING (host) GROUP BY 1, 2""",
    "url_substitution": _COPIES + f""" SELECT submission_id, CASE WHEN c.prov = 'mixed' AND n_rows >= 3 THEN 'https://stored.example/' || sha256(c.base) || '.pdf' WHEN c.prov = 'mixed' AND c.coaching IS NOT NULL THEN 'https://archived.example/' || c.base ELSE {S.base("s.url")} END || {_FRAG} AS url
FROM submissions s LEFT JOIN copies c ON c.base = {S.base("s.url")}""",
    "link_resolve": f"""WITH l AS (SELECT copy_id, trim(coalesce(url, '')) AS u, verified FROM link_copies), mv AS (SELECT split_part(u, '#', 1) AS old, min('https://moved.example/' || sha1(u)) AS moved FROM l WHERE NOT verified AND u <> '' GROUP BY 1),
b AS (SELECT * FROM l UNION ALL SELECT -copy_id, 'https://drive.google.com/file/d/' || sha1(u) || '/view', verified FROM l WHERE verified)
SELECT copy_id, CASE WHEN moved IS NOT NULL THEN moved WHEN u LIKE 'https://drive.google.com/file/d/%' THEN 'https://drive.google.com/uc?export=download&id=' || regexp_extract(u, '/file/d/([^/?]+)', 1) ELSE u END AS fetch_url,
  CASE WHEN moved IS NOT NULL THEN 'moved' WHEN u LIKE 'https://drive.google.com/file/d/%' THEN 'drive-file' ELSE 'direct' END AS note FROM b LEFT JOIN mv ON old = split_part(u, '#', 1)""",
    "capture_latest": f"""WITH s AS (SELECT submission_id, {S.base("url")} AS base, md5({S.norm("question")}) AS digest, received_at FROM submissions WHERE {S.base("url")} <> ''), w AS (SELECT base, arg_min(digest, submission_id) AS digest FROM s GROUP BY 1)
SELECT base, max(received_at) AS captured_at, count(*) AS n FROM s JOIN w USING (base, digest) GROUP BY 1""",
    "corpus_union": "WITH " + _UNION + " SELECT * FROM u",
    "work_corpus": "WITH " + _UNION + f""", r AS (SELECT DISTINCT {S.base("url")} AS base FROM ocr_questions WHERE salvaged), n AS (SELECT DISTINCT base FROM u WHERE kind = 'link' OR base IN (SELECT base FROM r))
SELECT base, 'new' AS why FROM n WHERE base NOT IN (SELECT {S.base("url")} FROM submissions) UNION ALL SELECT base, 'redo' FROM r""",
    "optional_admission": f"""WITH e AS (SELECT unit_key, min({S.base("url")}) AS base, min(paper) AS subject, count(*) FILTER (trim(question) <> '') AS n_questions, min(ocr_id) AS ord FROM ocr_questions WHERE {S.paper("paper")} = 'Optional' GROUP BY 1)
SELECT unit_key, n_questions, CASE WHEN coalesce(base, '') = '' OR coalesce(trim(subject), '') = '' THEN 'lacks a field' WHEN ord > min(ord) OVER (PARTITION BY base) THEN 'conflict' ELSE 'taken' END AS reason FROM e""",
    "link_conflicts": "WITH " + _UNION + f""", o AS (SELECT DISTINCT person FROM u WHERE kind = 'scan' AND paper = 'Optional'), l AS (SELECT copy_id, {S.name_key("topper")} AS person, {S.paper("paper")} AS paper FROM link_copies)
SELECT copy_id, CASE WHEN person NOT IN (SELECT person FROM o) THEN 'taken' WHEN paper <> 'Optional' THEN 'clash of papers' ELSE 'optional' END AS reason FROM l""",
    "source_union": f"""WITH lines AS ({_LINES}), r AS (SELECT 'submissions' AS src, submission_id AS ord, topper, question, url, prov FROM submissions UNION ALL SELECT 'lines', record_id, topper, question, url, 'community' FROM lines
  UNION ALL SELECT 'scans', ocr_id, NULL, question, url, 'ocr' FROM ocr_questions WHERE NOT salvaged), k AS (SELECT *, {S.q_key("question")} AS qkey, {S.base("url")} AS base FROM r)
SELECT src, ord, topper, question, CASE WHEN base LIKE '%\\_copy.pdf' ESCAPE '\\' THEN 'https://moved.example/' || {S.slug("base")} ELSE base END || CASE WHEN url IS NULL THEN '' ELSE {_FRAG} END AS url, prov FROM k
WHERE qkey NOT IN (SELECT {S.q_key("question")} FROM ocr_questions WHERE salvaged) AND base NOT IN (SELECT {S.base("url")} FROM link_copies)""",
    "positional_outcomes": f"""WITH o AS (SELECT DISTINCT {S.name_key("topper")} AS person, {S.base("url")} AS old_url, {_YEAR("url")} AS old_year FROM submissions WHERE {S.base("url")} <> '' AND {S.name_key("topper")} <> ''),
n AS (SELECT {S.name_key("topper")} AS person, {S.base("url")} AS new_url, min(year) AS new_year, bool_or(coalesce(verified, false)) AS available FROM link_copies WHERE {S.name_key("topper")} <> '' GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY old_url) AS k, count(*) OVER (PARTITION BY person) AS na FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY new_url) AS k, count(*) OVER (PARTITION BY person) AS nb FROM n),
c AS (SELECT person, count(*) AS nb FROM n GROUP BY 1)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c.nb IS NULL THEN 'no new' WHEN c.nb <> na THEN 'count mismatch' WHEN old_year IS NOT NULL AND new_year IS DISTINCT FROM old_year THEN 'year mismatch' WHEN NOT available THEN 'no file' ELSE 'paired' END AS outcome
  FROM a LEFT JOIN c USING (person) LEFT JOIN b USING (person, k) UNION ALL SELECT 'fresh' FROM n WHERE person NOT IN (SELECT person FROM o)) GROUP BY 1""",
    "redo_representatives": rf"""WITH u AS (SELECT DISTINCT {S.base("url")} AS url FROM submissions WHERE {S.base("url")} <> ''), k AS (SELECT url, regexp_extract(url, '/(\d{{4}}/\d{{5}})_', 1) AS k FROM u),
c AS (SELECT url, CASE WHEN k <> '' THEN {S.host("url")} || ':' || k ELSE 'SINGLETON:' || url END AS cluster FROM k), r AS (SELECT cluster, arg_min(url, (NOT regexp_matches(url, '_gs[1-4]'), length(url), url)) AS representative FROM c GROUP BY 1)
SELECT DISTINCT representative AS url FROM (SELECT DISTINCT {S.base("url")} AS url FROM submissions WHERE prov = 'ocr' AND {S.base("url")} <> '') JOIN c USING (url) JOIN r USING (cluster)""",
    "publisher_clusters": rf"""WITH u AS (SELECT DISTINCT {S.base("url")} AS url FROM (SELECT url FROM submissions UNION ALL SELECT url FROM link_copies UNION ALL SELECT url FROM ocr_questions) WHERE {S.base("url")} <> ''),
k AS (SELECT url, {S.host("url")} AS host, coalesce(nullif(regexp_extract(url, '/(\d{{4}}/\d{{5}})_', 1), ''), nullif(regexp_extract(url, '/link/(\d{{6,}})_', 1), ''), nullif(regexp_extract(url, '/ocr/(\d{{6,}})_', 1), ''), nullif(regexp_extract(url, '/compiled/([a-z0-9_]+)\.pdf', 1), '')) AS k FROM u),
g AS (SELECT host, coalesce(k, url) AS c, k IS NULL AS single, count(*) AS n FROM k GROUP BY ALL) SELECT host, sum(n)::BIGINT AS n_urls, count(*) AS n_clusters, count(*) FILTER (single) AS n_single, round(1 - count(*) / sum(n), 6) AS saved FROM g GROUP BY 1""",
    "cluster_records": """SELECT unit_key, count(*) AS n, min(page) AS first_page FROM ocr_questions WHERE unit_key IS NOT NULL AND url IS NOT NULL AND unit_key NOT IN (SELECT unit_key FROM ocr_questions WHERE salvaged AND unit_key IS NOT NULL) GROUP BY 1""",
    "optional_merge": f"""WITH b AS (SELECT unit_key, {_SHORT64} AS key, arg_min(coalesce(salvaged, false), (coalesce(salvaged, false), ocr_id)) AS added FROM ocr_questions WHERE unit_key IS NOT NULL GROUP BY 1, 2)
SELECT unit_key, count(*) FILTER (NOT added) AS n_prior, count(*) FILTER (added) AS n_added FROM b WHERE key <> '' GROUP BY 1""",
    "refs_resolved": _COPIES + f""", r AS (SELECT DISTINCT paper, {S.norm("question")} AS norm, base FROM src WHERE base <> '') SELECT r.paper, count(*) AS n_refs, count(*) FILTER (c.topper <> 'Unknown') AS n_known, count(*) FILTER (c.topper <> 'Unknown') < 0.5 * count(*) AS stale FROM r LEFT JOIN copies c USING (base) GROUP BY 1""",
    "interview_texts": "SELECT doc_id, year, source, CASE WHEN trim(text) <> '' THEN length(text) ELSE 0 END AS n_chars FROM documents WHERE kind = 'interview_transcript'",
    "work_list": """SELECT * FROM (SELECT unit_key, bool_or(coalesce(salvaged, false)) AS redo, bool_or(marks IS NOT NULL) AS hit FROM ocr_questions WHERE unit_key IS NOT NULL GROUP BY 1 HAVING NOT bool_or(question IS NULL) AND NOT bool_or(page IS NULL)) WHERE redo OR NOT hit""",
    "routed_upsert": f"""WITH l AS (SELECT *, {S.name_key("topper")} AS key, {S.paper("paper")} AS p FROM link_copies), r AS (SELECT *, CASE WHEN key IN ('', 'unknown') THEN 'no name' WHEN air NOT BETWEEN 1 AND 1100 THEN 'rank out of range' WHEN year NOT BETWEEN 2013 AND 2030 THEN 'year out of range' WHEN {S.base("url")} = '' THEN 'no address' END AS reason FROM l)
SELECT copy_id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN air IS NOT NULL AND key IN (SELECT {S.name_key("topper")} FROM toppers) THEN 'override' WHEN p = 'Optional' THEN 'optional' ELSE 'link' END AS route, reason FROM r""",
}
ORACLE["copies_with_slugs"] = _COPIES.replace("WITH ", "WITH RECURSIVE ", 1) + rf""", n AS (SELECT topper, min(base) AS ord, {S.slug("topper")} AS slug FROM copies WHERE topper IS NOT NULL GROUP BY 1),
k AS (SELECT *, regexp_replace(slug, '(?:-\d+)+$', '') AS stem, row_number() OVER (PARTITION BY regexp_replace(slug, '(?:-\d+)+$', '') ORDER BY ord) AS k FROM n),
f AS (SELECT stem, k, topper, slug AS made, [slug] AS taken FROM k WHERE k = 1 UNION ALL
  SELECT stem, k, topper, m, list_append(taken, m) FROM (SELECT k.stem, k.k, k.topper, f.taken, list_filter(list_transform(range(1, len(f.taken) + 2), lambda i: CASE WHEN i = 1 THEN k.slug ELSE k.slug || '-' || i END), lambda x: NOT list_contains(f.taken, x))[1] AS m
    FROM f JOIN k ON k.stem = f.stem AND k.k = f.k + 1))
SELECT base, c.topper, made AS unique_slug FROM copies c LEFT JOIN f ON c.topper = f.topper"""
