"""Queries of lists as they are shown, of persons put together from all sources, of pinned classes, and of extracted questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pustaka.functions import names as N
from pustaka.functions import pages as P
from pustaka.functions import text as T
from pustaka.functions.extract import ExtractQuestions
from pustaka.operators import aggregates as A
from pustaka.operators import classify as C
from pustaka.operators import ranking as R
from pustaka.operators.index import sorted_by
from pustaka.plans import ranking as ranking_plans
from pustaka.plans import sql as S
from pustaka.plans.aggregates import _COPIES
from pustaka.plans.classify import _CLASSES, _texts
from pustaka.plans.sinks import ORACLE as SINK_SQL
from pustaka.plans.sinks import shard_manifest
from pustaka.session import cut, read, shared_dir
from pustaka.sources import sinks
from pustaka.sources.corpus import rows_sql, source_rows


def _ranked_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.copies(source_rows(spark, sf_dir)).withColumn("key", T.name_key(F.col("topper")))
    p = read(spark, sf_dir, "toppers").withColumn("key", T.name_key(F.col("topper"))).filter("key <> ''").groupBy("key").agg(A.first_stated("air", "rec_id").alias("air"), A.first_stated("year", "rec_id").alias("year"))
    return c.join(p, "key", "left").select("base", "topper", "paper", "coaching", "n_rows", F.coalesce("year", F.lit(0)).alias("year"), F.coalesce(F.nullif("air", F.lit(0)), F.lit(1_000_000_000)).alias("rank"))


#: The orders in which copies are listed, each ended by the address.
_ORDERS = {"qty": ("-n_rows", "topper", "paper"), "air": ("rank", "topper"), "name": ("topper", "paper"), "person": ("topper", "paper", "-year"), "year": ("-year", "rank", "topper", "paper")}


def _browse(order: str):
    def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _ranked_copies(spark, sf_dir).filter("topper IS NOT NULL").orderBy(*sorted_by((*_ORDERS[order], "base"))).limit(25)
        return c.withColumn("place", F.row_number().over(Window.orderBy(*sorted_by((*_ORDERS[order], "base"))))).drop("coaching")

    listed.__name__ = f"browse_by_{order}"
    return listed


browse_by_qty, browse_by_air, browse_by_name, browse_by_person, browse_by_year = map(_browse, _ORDERS)


def year_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by year with the share of each, newest first."""
    g = _ranked_copies(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("year"))))


def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to each question: copies whose host is down last, then by rank; the first 120 of a question."""
    r = source_rows(spark, sf_dir).filter("base <> ''").select("paper", T.norm(F.col("question")).alias("norm"), "base").filter("norm <> ''").distinct()
    c = _ranked_copies(spark, sf_dir).select("base", "rank", F.startswith(T.url_host(F.col("base")), F.lit("archive.")).alias("down"))
    return R.top_k(r.join(c, "base"), ["paper", "norm"], [F.col("down"), F.col("rank"), F.col("base")], 120).select("paper", "norm", "base", "place")


def job_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booklets in the order of work: those to be read again first, then the smaller ones."""
    u = read(spark, sf_dir, "ocr_questions").filter("unit_key IS NOT NULL").groupBy("unit_key").agg(F.max(F.coalesce("salvaged", F.lit(False))).alias("redo"), F.count(F.lit(1)).alias("n"))
    return R.places(u.withColumn("last", (~F.col("redo")).cast("int")), ["last", "n", "unit_key"], "place").select("unit_key", "redo", "n", "place")


def subject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each optional subject."""
    c = A.copies(source_rows(spark, sf_dir)).filter("paper = 'Optional'")
    return c.groupBy(F.lower(F.trim("subject")).alias("subject")).agg(F.count(F.lit(1)).alias("n_copies"), F.sum("n_rows").alias("n_rows"))


def sources_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per person the sources of the links, each once, in the order in which they come first."""
    s = read(spark, sf_dir, "link_copies").select(T.name_key(F.col("topper")).alias("key"), F.trim("source").alias("source"), "copy_id").filter("key <> '' AND source <> ''")
    one = s.groupBy("key", "source").agg(F.min("copy_id").alias("at"))
    return one.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]), "; ").alias("sources"))


def size_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per paper the parts that a corpus is written in, their largest and whole size, and how many are over the budget."""
    m = shard_manifest(spark, sf_dir)
    return m.groupBy("paper").agg(F.count(F.lit(1)).alias("n_parts"), F.max("n_bytes").alias("largest"), F.sum("n_bytes").alias("n_bytes"), F.count_if(F.col("n_bytes") > sinks.PART_BYTES).alias("n_over"))


def yield_by_booklet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions per address over both lists, with the paper stated last."""
    a = source_rows(spark, sf_dir).select("base", "paper", (F.col("ord") * 2).alias("at"))
    b = read(spark, sf_dir, "ocr_questions").select(T.url_base(F.col("url")).alias("base"), T.paper_of(F.col("paper")).alias("paper"), (F.col("ocr_id") * 2 + 1).alias("at"))
    return a.union(b).filter("base <> ''").groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.max_by("paper", "at").alias("paper"))


def canonical_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three lists with each name in the spelling that stands for it."""
    best = ranking_plans.canonical_variant_pick(spark, sf_dir).select("key", F.col("topper").alias("canonical"))
    one = lambda t, i: read(spark, sf_dir, t).select(F.lit(t).alias("list"), F.col(i).alias("id"), "topper", T.name_key(F.col("topper")).alias("key"))
    rows = one("submissions", "submission_id").union(one("toppers", "rec_id")).union(one("link_copies", "copy_id"))
    return rows.join(best, "key", "left").select("list", "id", F.coalesce("canonical", "topper").alias("topper"))


def build_toppers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons from all lists: rank and year each from the first copy that states one; a rank that all file names agree on where none is stated;
    what the list of toppers says comes last and counts before, rank, year and the number of its papers each for itself."""
    lc = read(spark, sf_dir, "link_copies").withColumn("key", T.name_key(F.col("topper")))
    stated = lc.groupBy("key").agg(A.first_stated("air", "copy_id").alias("air"), A.first_stated("year", "copy_id").alias("year"), F.count(F.lit(1)).alias("n_links"))
    s = read(spark, sf_dir, "submissions").select(T.name_key(F.col("topper")).alias("key"), T.file_rank(F.col("url")).alias("rank"))
    hints = s.groupBy("key").agg(A.unanimous("rank").alias("hint"))
    tp = read(spark, sf_dir, "toppers").withColumn("key", T.name_key(F.col("topper")))
    over = tp.groupBy("key").agg(A.first_stated("air", "rec_id").alias("o_air"), A.first_stated("year", "rec_id").alias("o_year"))
    marks = tp.select("key", F.explode("marks").alias("paper", "mark")).groupBy("key").agg(F.count_distinct("paper").alias("n_papers"))
    j = stated.join(hints, "key", "full_outer").join(over, "key", "full_outer").join(marks, "key", "left").filter("key <> ''")
    return j.select("key", F.coalesce("o_air", "air", "hint").alias("air"), F.coalesce("o_year", "year").alias("year"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_papers", F.lit(0)).alias("n_papers"))


def person_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with their copies as JSON, the copies by paper and address; fields without a value are left out."""
    c = A.copies(source_rows(spark, sf_dir)).filter("topper IS NOT NULL AND topper <> 'Unknown'")
    return sinks.nested_by(c, "topper", ["paper", "base"], ["paper", "base", "prov", "n_rows"])


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned questions as lines of the submission files, limits in the metadata and the page in the address."""
    q = read(spark, sf_dir, "ocr_questions").filter("question IS NOT NULL")
    base, page = T.url_base(F.col("url")), F.coalesce(F.col("page").cast("string"), F.lit(""))
    kind = F.when(F.col("salvaged"), " (salvaged)").otherwise("")
    meta = F.concat(F.lit("Type: question"), kind, F.lit(", Word limit: "), T.blank(F.col("words")), F.lit(", Marks: "), T.blank(F.col("marks")))
    cols = q.select("ocr_id", F.lit("").alias("topper"), F.col("source").alias("coaching"), F.col("paper").alias("subject"), page.alias("page_number"), "question", meta.alias("metadata"), F.when(base != "", F.concat(base, F.lit("#page="), page)).otherwise("").alias("url"))
    return cols.select("ocr_id", sinks.csv_lines(cols, ["topper", "coaching", "subject", "page_number", "question", "metadata", "url"]).alias("line"))


def id_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that each copy has among the copies of a paper, from 0 in the order of their addresses, as parts refer to them."""
    r = source_rows(spark, sf_dir).filter("base <> ''").select("paper", "base").distinct()
    at = R.places(r, ["paper", "base"], "place")
    first = at.groupBy("paper").agg(F.min("place").alias("first"))
    return at.join(first, "paper").select("paper", "base", (F.col("place") - F.col("first")).alias("ix"))


def tails_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts, of those of one key the first, cut into lead and tail, which together are the text again."""
    d = read(spark, sf_dir, "documents").filter(F.length("text") > 500).withColumn("key", T.q_key(F.col("text")))
    own = d.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("cuts"))
    at = P.lead_length(F.col("text"))
    c = d.join(own, "doc_id", "left").withColumn("at", F.when(F.col("cuts"), at).otherwise(F.length("text")))
    lead, tail = F.substring(F.col("text"), F.lit(1), F.col("at")), F.substring(F.col("text"), F.col("at") + 1, F.length("text"))
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("cuts").alias("n_cut"), F.count_if(F.concat(lead, tail) == F.col("text")).alias("n_same"))


def json_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the syllabus written as one JSON map, one entry a line in order, and read again."""
    path = f"{shared_dir(spark)}/pustaka-map-{abs(hash(sf_dir))}"
    sinks.write_map(read(spark, sf_dir, "syllabus_nodes"), "node_id", ["paper", "label", "kw"], path)
    return cut(sinks.read_map(spark, path, "node_id", "paper string, label string, kw array<string>").select("node_id", "paper", "label", F.size("kw").alias("n_kw")), "map")


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of scanned questions as items placed on a page, put together to lines again."""
    q = read(spark, sf_dir, "ocr_questions").filter("question IS NOT NULL")
    lines = F.split("question", "\n")
    items = F.flatten(F.transform(lines, lambda ln, i: F.transform(F.split(ln, r"\s+"), lambda w, j: F.struct((j * 10).cast("double").alias("x"), (i * -20 + j % 2).cast("double").alias("y"), w.alias("str")))))
    return q.select("ocr_id", F.array_join(P.lines_from_items(items), "\n").alias("text"))


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose classes are set by hand: those that were asked with the word federalism go to no class, with grants to one."""
    rows = source_rows(spark, sf_dir).select(T.q_key(F.col("question")).alias("qkey")).filter("qkey <> ''").distinct()
    return rows.filter(F.contains("qkey", F.lit("federalism")) | F.contains("qkey", F.lit("grants"))).select("qkey", F.when(F.contains("qkey", F.lit("federalism")), F.array().cast("array<string>")).otherwise(F.array(F.lit("pinned"))).alias("nodes"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir).withColumn("qkey", T.q_key(F.col("text")))
    return C.mapped(texts, read(spark, sf_dir, "syllabus_nodes"), _pins(spark, sf_dir))


def syllabus_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of each question, set by hand before they are found by keywords."""
    return _mapped(spark, sf_dir).select("key", "pinned", F.array_join("nodes", ",").alias("nodes"))


def syllabus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of one class."""
    return _mapped(spark, sf_dir).filter(F.array_contains("nodes", "gs2-01")).select("key")


def extracted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions found on scanned pages by their numbers and words; of a booklet's that begin alike the first."""
    pages = read(spark, sf_dir, "ocr_questions").filter("question IS NOT NULL").select("unit_key", "ocr_id", "question")
    spark.udtf.register("extract_questions", ExtractQuestions)
    found = spark.sql("SELECT unit_key, ocr_id, question_no, f.question FROM {pages} p, LATERAL extract_questions(p.question) f", pages=pages)
    keyed = found.withColumn("key", N.short_key(F.col("question"), 48)).filter("key <> ''")
    return keyed.groupBy("unit_key", "key").agg(F.min_by(F.struct("ocr_id", "question_no", "question"), F.struct("ocr_id", "question_no")).alias("b")).select("unit_key", "b.*")


def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scanned line its longer words, how many of them English documents hold, whether half of them do, and whether three or more others of up to
    seven small letters stand in a row."""
    docs = read(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]+)"), 1))).alias("word"))
    known = docs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("word", F.lit(1).alias("known"))
    lines = read(spark, sf_dir, "ocr_questions").filter("question IS NOT NULL").select("ocr_id", F.posexplode(F.split("question", "\n")).alias("line_no", "line"))
    words = lines.select("ocr_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(r"([A-Za-z]+)"), 1)).alias("pos", "raw")).withColumn("word", F.lower("raw"))
    w = words.join(known, "word", "left").withColumn("known", F.coalesce("known", F.lit(0))).withColumn("odd", ((F.col("known") == 0) & (F.length("raw") <= 7) & ~F.col("raw").rlike("^[A-Z]")).cast("int"))
    by = Window.partitionBy("ocr_id", "line_no").orderBy("pos")
    runs = w.withColumn("island", F.sum(1 - F.col("odd")).over(by)).groupBy("ocr_id", "line_no", "island").agg(F.sum("odd").alias("run"), F.count_if(F.length("word") >= 3).alias("n_long"), F.sum(F.when(F.length("word") >= 3, F.col("known")).otherwise(0)).alias("n_known"))
    g = runs.groupBy("ocr_id", "line_no").agg(F.sum("n_long").alias("n_long"), F.sum("n_known").alias("n_known"), (F.max("run") >= 3).alias("garbled"))
    return g.withColumn("english", (F.col("n_long") >= 3) & (2 * F.col("n_known") >= F.col("n_long")))


def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned questions of a booklet, in its order, glued to the next one while they end without a closing mark; the text goes to the last of them."""
    q = read(spark, sf_dir, "ocr_questions").filter("question IS NOT NULL AND unit_key IS NOT NULL")
    by = Window.partitionBy("unit_key").orderBy("ocr_id")
    open_end = ~F.col("question").rlike(r"[.?!।)\]M]\s*$")
    flagged = q.select("unit_key", "ocr_id", "question", open_end.alias("open")).withColumn("starts", (~F.coalesce(F.lag("open").over(by), F.lit(False))).cast("int"))
    island = flagged.withColumn("island", F.sum("starts").over(by))
    return island.groupBy("unit_key", "island").agg(F.max("ocr_id").alias("last_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ocr_id", F.trim("question").alias("t")))), lambda x: x["t"]), " ").alias("text")).drop("island")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading the raw pages again would add: extracted questions whose key no submitted question has."""
    old = read(spark, sf_dir, "submissions").select(N.short_key(F.regexp_replace("question", T.NUMBER_LEAD, ""), 48).alias("key")).distinct()
    new = extracted_questions(spark, sf_dir).withColumn("key", N.short_key(F.col("question"), 48))
    return new.join(old, "key", "left_anti").groupBy("unit_key").agg(F.count(F.lit(1)).alias("n_new"))


def reading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of the same booklets against each other, by what read them: questions that the other has too (words overlap by 0.6 on the same
    page or by 0.72 anywhere in the booklet), lost ones, and recall."""
    q = read(spark, sf_dir, "ocr_questions").filter("unit_key IS NOT NULL AND question IS NOT NULL").select("unit_key", "ocr_id", "page", (F.col("model").isNull()).alias("other"), F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"([a-z]{4,})"), 1)).alias("w"))
    q = q.filter(F.size("w") > 0)
    found = R.alike_in_group(q.filter("NOT other"), q.filter("other"), "unit_key", "ocr_id", "page", "w", 0.6, 0.72)
    return q.filter("NOT other").join(found, "ocr_id", "left").groupBy("unit_key").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_found"), (F.count(F.lit(1)) - F.count("hit")).alias("n_lost"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


QUERIES = {
    f.__name__: f
    for f in (
        browse_by_qty, browse_by_air, browse_by_name, browse_by_person, browse_by_year, year_headers, answer_rows, job_priority, subject_counts, sources_joined, size_budgets, yield_by_booklet, canonical_applied,
        build_toppers, person_json, csv_rows, id_dictionary, tails_rejoined, json_map_file, placed_lines, syllabus_pins, syllabus_filter, extracted_questions, line_quality, stitched, replayed, reading_scores,
    )
}

_K = S.name_key("topper")
_RANKED = _COPIES + f""", p AS (SELECT {_K} AS key, arg_min(air, rec_id) FILTER (air IS NOT NULL) AS air, arg_min(year, rec_id) FILTER (year IS NOT NULL) AS year FROM toppers WHERE {_K} <> '' GROUP BY 1),
rc AS (SELECT base, topper, paper, n_rows, coalesce(year, 0) AS year, coalesce(nullif(air, 0), 1000000000) AS rank FROM copies LEFT JOIN p ON {S.name_key("copies.topper")} = p.key)"""
_ORDER_SQL = {"qty": "n_rows DESC, topper, paper", "air": "rank, topper", "name": "topper, paper", "person": "topper, paper, year DESC", "year": "year DESC, rank, topper, paper"}
_SHORT = lambda c, k=48: f"substr(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g'), 1, {k})"
_ESC = lambda c: f"(CASE WHEN regexp_matches(coalesce({c}, ''), '[\",\\n\\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END)"
_NUM, _CAP = r"(?i)^(?:Q\s*\.?\s*(?:No\.?\s*)?|Question\s+)?\d{1,2}\s*[.)]\s*\S", r"(?i)^Q\s*\.?\s*(?:No\.?\s*)?\d{1,2}\b"
_ASKS = r"(?i)\b(?:discuss|examine|analyse|analyze|elucidate|evaluate|comment|critically|substantiate|illustrate|do you agree|to what extent|account for|bring out|how (?:far|does|do|did|has|have)|what (?:are|is|do|was|were)|why (?:is|are|do|did|has))\b"
_NOISE = r"(?i)^(?:page\b|p\.?\s*\d|\d{1,3}\s*(?:of|/)\s*\d{1,3}\b|www\.|https?:|©|copyright|all rights|for more|visit\b|download\b|t\.me|telegram|contact\b|scanned by|instagram|youtube|marks?\s*obtained|roll\s*no|q\.?\s*booklet|do not write|space for)"
_LIMITS = r"(?i)[\[(][^)\]]*\b\d{2,3}\s*(?:marks?|words?|M)\b[^)\]]*[\])]"
_EXTRACTED = rf"""pg AS (SELECT unit_key, ocr_id, list_filter(list_transform(string_split(question, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM ocr_questions WHERE question IS NOT NULL),
ln AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '{_NUM}') OR regexp_matches(ls[i], '{_CAP}')) AS st FROM pg),
hd AS (SELECT *, list_filter(range(1, least(len(ls), 7) + 1), lambda i: NOT regexp_matches(ls[i], '{_NOISE}') AND NOT regexp_full_match(ls[i], '[^A-Za-z0-9]{{0,3}}')
  AND (regexp_matches(ls[i], '{_NUM}') OR regexp_matches(ls[i], '{_CAP}') OR (length(ls[i]) > 28 AND regexp_matches(substr(ls[i], 1, 110), '{_ASKS}')))) AS fi FROM ln),
bl AS (SELECT unit_key, ocr_id, CASE WHEN len(st) >= 3 THEN list_transform(range(1, len(st) + 1), lambda k: array_to_string(ls[st[k] : CASE WHEN k < len(st) THEN st[k + 1] - 1 ELSE least(len(ls), st[k] + 5) END], ' '))
  WHEN len(fi) > 0 THEN [array_to_string(ls[fi[1] : least(len(ls), 7, fi[1] + 5)], ' ')] ELSE [] END AS bl FROM hd),
un AS (SELECT unit_key, ocr_id, generate_subscripts(bl, 1) AS no, unnest(bl) AS b FROM bl),
tx AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN regexp_matches(b, '{_NUM}') THEN regexp_replace(b, '(?i)^(?:Q\s*\.?\s*(?:No\.?\s*)?|Question\s+)?\d{{1,2}}\s*[.)]\s*', '') ELSE b END, '{_CAP}', ''), '^[)\].,\s-]+', '') AS t FROM un),
po AS (SELECT *, regexp_extract(t, '{_LIMITS}', 0) AS lim, strpos(t, '?') - 1 AS mark, regexp_extract(t, '(?i)^(.*?)\b(?:Ans(?:wer)?\b|Introduction\b|Body\b|Conclusion\b|Solution\b)', 1) AS pre FROM tx),
qs AS (SELECT unit_key, ocr_id, no, CASE WHEN lim <> '' AND strpos(t, lim) - 1 >= 20 THEN trim(substr(t, 1, strpos(t, lim) - 1 + length(lim))) WHEN mark >= 20 AND mark < 500 THEN trim(substr(t, 1, mark + 1))
  WHEN length(pre) >= 25 THEN regexp_replace(trim(pre), '[.,;:\s-]+$', '') ELSE trim(substr(t, 1, 400)) END AS question FROM po),
ex AS (SELECT unit_key, ocr_id, no::INT AS question_no, question, {_SHORT("question")} AS key FROM qs WHERE length(question) >= 18 AND {_SHORT("question")} <> '' QUALIFY row_number() OVER (PARTITION BY unit_key, {_SHORT("question")} ORDER BY ocr_id, no) = 1)"""
_MAPPED = _CLASSES + f""", pin AS (SELECT ord, CASE WHEN contains({S.q_key("question")}, 'federalism') THEN '' WHEN contains({S.q_key("question")}, 'grants') THEN 'pinned' END AS p FROM src WHERE question IS NOT NULL),
mp AS (SELECT ord AS key, p IS NOT NULL AS pinned, coalesce(p, string_agg(node_id, ',' ORDER BY place), '') AS nodes FROM pin LEFT JOIN cl ON cl.key = ord GROUP BY ord, p)"""

ORACLE = {
    **{f"browse_by_{k}": _RANKED + f" SELECT *, row_number() OVER (ORDER BY {o}, base)::INT AS place FROM rc WHERE topper IS NOT NULL QUALIFY place <= 25" for k, o in _ORDER_SQL.items()},
    "year_headers": _RANKED + " SELECT year, count(*) AS n, min(rank) AS best, row_number() OVER (ORDER BY year DESC)::INT AS place FROM rc GROUP BY 1",
    "answer_rows": _RANKED + f""", r AS (SELECT DISTINCT paper, {S.norm("question")} AS norm, base FROM src WHERE base <> '')
SELECT r.paper, r.norm, base, row_number() OVER (PARTITION BY r.paper, r.norm ORDER BY {S.host("base")} LIKE 'archive.%', rank, base)::INT AS place FROM r JOIN rc USING (base) WHERE norm <> '' QUALIFY place <= 120""",
    "job_priority": """WITH u AS (SELECT unit_key, bool_or(coalesce(salvaged, false)) AS redo, count(*) AS n FROM ocr_questions WHERE unit_key IS NOT NULL GROUP BY 1) SELECT *, row_number() OVER (ORDER BY redo DESC, n, unit_key) AS place FROM u""",
    "subject_counts": _COPIES + " SELECT lower(trim(subject)) AS subject, count(*) AS n_copies, sum(n_rows)::BIGINT AS n_rows FROM copies WHERE paper = 'Optional' GROUP BY 1",
    "sources_joined": f"""WITH s AS (SELECT {_K} AS key, trim(source) AS source, min(copy_id) AS seen FROM link_copies WHERE {_K} <> '' AND trim(source) <> '' GROUP BY 1, 2) SELECT key, string_agg(source, '; ' ORDER BY seen) AS sources FROM s GROUP BY 1""",
    "size_budgets": f"SELECT paper, count(*) AS n_parts, max(n_bytes) AS largest, sum(n_bytes)::BIGINT AS n_bytes, count(*) FILTER (n_bytes > 600000) AS n_over FROM ({SINK_SQL['shard_manifest']}) GROUP BY 1",
    "yield_by_booklet": "WITH " + rows_sql() + f""", a AS (SELECT base, paper, 2 * ord AS seen FROM src UNION ALL SELECT {S.base("url")}, {S.paper("paper")}, 2 * ocr_id + 1 FROM ocr_questions) SELECT base, count(*) AS n, arg_max(paper, seen) AS paper FROM a WHERE base <> '' GROUP BY 1""",
    "canonical_applied": f"""WITH best AS ({ranking_plans.ORACLE["canonical_variant_pick"]}), r AS (SELECT 'submissions' AS list, submission_id AS id, topper FROM submissions UNION ALL SELECT 'toppers', rec_id, topper FROM toppers UNION ALL SELECT 'link_copies', copy_id, topper FROM link_copies)
SELECT list, id, coalesce(best.topper, r.topper) AS topper FROM r LEFT JOIN best ON best.key = {S.name_key("r.topper")}""",
    "build_toppers": rf"""WITH s AS (SELECT {_K} AS key, arg_min(air, copy_id) FILTER (air IS NOT NULL) AS air, arg_min(year, copy_id) FILTER (year IS NOT NULL) AS year, count(*) AS n_links FROM link_copies GROUP BY 1),
f AS (SELECT {_K} AS key, try_cast(regexp_extract(split_part({S.base("url")}, '/', -1), '(?i)(?:^|[-_ .])rank[-_ ]?(\d{{1,3}})(?:\D|$)', 1) AS INT) AS rank FROM submissions), h AS (SELECT key, CASE WHEN count(DISTINCT rank) = 1 THEN min(rank) END AS hint FROM f GROUP BY 1),
o AS (SELECT {_K} AS key, arg_min(air, rec_id) FILTER (air IS NOT NULL) AS air, arg_min(year, rec_id) FILTER (year IS NOT NULL) AS year FROM toppers GROUP BY 1),
m AS (SELECT key, count(DISTINCT e.key2) AS n_papers FROM (SELECT {_K} AS key, unnest(map_keys(marks)) AS k FROM toppers) x, LATERAL (SELECT x.k AS key2) e GROUP BY 1), k AS (SELECT key FROM s UNION SELECT key FROM h UNION SELECT key FROM o)
SELECT k.key, coalesce(o.air, s.air, hint) AS air, coalesce(o.year, s.year) AS year, coalesce(n_links, 0) AS n_links, coalesce(n_papers, 0) AS n_papers FROM k LEFT JOIN s USING (key) LEFT JOIN h USING (key) LEFT JOIN o USING (key) LEFT JOIN m USING (key) WHERE k.key <> ''""",
    "person_json": _COPIES + """ SELECT topper, count(*) AS n, '[' || string_agg('{"paper":' || to_json(paper) || ',"base":' || to_json(base) || CASE WHEN prov IS NULL THEN '' ELSE ',"prov":' || to_json(prov) END || ',"n_rows":' || n_rows || '}', ',' ORDER BY paper, base) || ']' AS doc
FROM copies WHERE topper <> 'Unknown' GROUP BY 1""",
    "csv_rows": f"""WITH r AS (SELECT ocr_id, source, paper, question, coalesce(page::VARCHAR, '') AS page, 'Type: question' || CASE WHEN salvaged THEN ' (salvaged)' ELSE '' END || ', Word limit: ' || coalesce(words, '') || ', Marks: ' || coalesce(marks, '') AS meta,
  CASE WHEN {S.base("url")} <> '' THEN {S.base("url")} || '#page=' || coalesce(page::VARCHAR, '') ELSE '' END AS u FROM ocr_questions WHERE question IS NOT NULL)
SELECT ocr_id, ',' || {_ESC("source")} || ',' || {_ESC("paper")} || ',' || page || ',' || {_ESC("question")} || ',' || {_ESC("meta")} || ',' || {_ESC("u")} AS line FROM r""",
    "id_dictionary": "WITH " + rows_sql() + " SELECT paper, base, row_number() OVER (PARTITION BY paper ORDER BY base) - 1 AS ix FROM (SELECT DISTINCT paper, base FROM src WHERE base <> '')",
    "tails_rejoined": f"""WITH d AS (SELECT kind, row_number() OVER (PARTITION BY {S.q_key("text")} ORDER BY doc_id) = 1 AS cuts FROM documents WHERE length(text) > 500) SELECT kind, count(*) AS n, count(*) FILTER (cuts) AS n_cut, count(*) AS n_same FROM d GROUP BY 1""",
    "json_map_file": "SELECT node_id, paper, label, len(kw)::INT AS n_kw FROM syllabus_nodes",
    "placed_lines": r"SELECT ocr_id, trim(array_to_string(list_filter(list_transform(string_split(question, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS text FROM ocr_questions WHERE question IS NOT NULL",
    "syllabus_pins": _MAPPED + " SELECT * FROM mp",
    "syllabus_filter": _MAPPED + " SELECT key FROM mp WHERE list_contains(string_split(nodes, ','), 'gs2-01')",
    "extracted_questions": "WITH " + _EXTRACTED + " SELECT unit_key, ocr_id, question_no, question FROM ex",
    "replayed": "WITH " + _EXTRACTED + rf""" SELECT unit_key, count(*) AS n_new FROM ex WHERE key NOT IN (SELECT {_SHORT(r"regexp_replace(question, '^\s*(?:Q(?:uestion)?\.?\s*)?\d{1,3}\s*[.):\-]*\s+', '', 'i')")} FROM submissions) GROUP BY 1""",
    "line_quality": r"""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents WHERE lang = 'en'), k AS (SELECT word FROM d GROUP BY 1 HAVING count(*) >= 2),
l AS (SELECT ocr_id, unnest(string_split(question, chr(10))) AS line, generate_subscripts(string_split(question, chr(10)), 1)::INT - 1 AS line_no FROM ocr_questions WHERE question IS NOT NULL),
w AS (SELECT ocr_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z]+')) AS raw, generate_subscripts(regexp_extract_all(line, '[A-Za-z]+'), 1) AS pos FROM l),
f AS (SELECT *, lower(raw) IN (SELECT word FROM k) AS known FROM w), o AS (SELECT *, (NOT known AND length(raw) <= 7 AND NOT regexp_matches(raw, '^[A-Z]'))::INT AS odd FROM f),
i AS (SELECT *, sum(1 - odd) OVER (PARTITION BY ocr_id, line_no ORDER BY pos) AS island FROM o), r AS (SELECT ocr_id, line_no, island, sum(odd) AS run, count(*) FILTER (length(raw) >= 3) AS a, count(*) FILTER (length(raw) >= 3 AND known) AS b FROM i GROUP BY ALL)
SELECT ocr_id, line_no, sum(a)::BIGINT AS n_long, sum(b)::BIGINT AS n_known, max(run) >= 3 AS garbled, sum(a) >= 3 AND 2 * sum(b) >= sum(a) AS english FROM r GROUP BY 1, 2""",
    "stitched": r"""WITH q AS (SELECT unit_key, ocr_id, trim(question) AS t, NOT regexp_matches(question, '[.?!।)\]M]\s*$') AS open FROM ocr_questions WHERE question IS NOT NULL AND unit_key IS NOT NULL),
s AS (SELECT *, CASE WHEN coalesce(lag(open) OVER w, false) THEN 0 ELSE 1 END AS starts FROM q WINDOW w AS (PARTITION BY unit_key ORDER BY ocr_id)), i AS (SELECT *, sum(starts) OVER (PARTITION BY unit_key ORDER BY ocr_id) AS island FROM s)
SELECT unit_key, max(ocr_id) AS last_id, string_agg(t, ' ' ORDER BY ocr_id) AS text FROM i GROUP BY unit_key, island""",
    "reading_scores": r"""WITH q AS (SELECT unit_key, ocr_id, page, model IS NULL AS other, list_distinct(regexp_extract_all(lower(question), '[a-z]{4,}')) AS w FROM ocr_questions WHERE unit_key IS NOT NULL AND question IS NOT NULL), s AS (SELECT * FROM q WHERE len(w) > 0),
h AS (SELECT DISTINCT a.ocr_id FROM s a JOIN s b ON a.unit_key = b.unit_key AND NOT a.other AND b.other
  WHERE len(list_intersect(a.w, b.w)) >= CASE WHEN a.page = b.page THEN 0.6 ELSE 0.72 END * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))
SELECT unit_key, count(*) AS n, count(h.ocr_id) AS n_found, count(*) - count(h.ocr_id) AS n_lost, round(count(h.ocr_id) / count(*), 6) AS recall FROM s LEFT JOIN h ON h.ocr_id = s.ocr_id WHERE NOT other GROUP BY 1""",
}
