"""An inverted word index over the different questions of a corpus, and searches in it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pustaka.functions import text as T

#: What a name that covers a term adds to a score, and how many results are on a page. Fixed values.
NAME_SCORE, PAGE = 1_000_000, 25
#: Words of a query, as many as the bits of a number.
MOST_TERMS = 62


@dataclass(frozen=True)
class SearchRequest:
    """A query: its text, whether all words or the exact phrase, equal facets, and the page."""

    text: str
    mode: str = "all"
    facets: dict[str, str] = field(default_factory=dict)
    page: int = 1

    @property
    def terms(self) -> list[str]:
        return T.query_terms(self.text)


def questions(rows: DataFrame) -> DataFrame:
    """(qid, paper, norm, text): the different questions; qid is a hash of paper and normalised text, the same in every build."""
    r = rows.withColumn("norm", T.norm(F.col("question"))).filter("norm <> ''")
    return r.groupBy("paper", "norm").agg(F.max_by("question", F.struct(F.length("question").alias("len"), (-F.col("ord")).alias("o"))).alias("text")).select(F.xxhash64("paper", "norm").alias("qid"), "paper", "norm", "text")


def refs(rows: DataFrame) -> DataFrame:
    """(qid, base, page): where each question stands."""
    r = rows.withColumn("norm", T.norm(F.col("question"))).filter("norm <> '' AND base <> ''")
    return r.select(F.xxhash64("paper", "norm").alias("qid"), "base", "page").distinct()


def postings(texts: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """(bucket, token, key): each word of each text once. `bucket`, its first two characters, prunes what a query reads."""
    t = texts.select(key, F.explode(F.array_distinct(T.index_tokens(F.col(text)))).alias("token"))
    return t.select(T.bucket_key(F.col("token")).alias("bucket"), "token", key)


def holds_term(term: str) -> Column:
    """The rows of the postings that a term matches: tokens that it starts, or the token itself if it is one character."""
    return F.startswith(F.col("token"), F.lit(term)) if len(term) > 1 else F.col("token") == term


def prune(term: str) -> Column:
    """The bucket in which the tokens of a term lie; a one-character token is alone in its own."""
    code = lambda c: c if c.isascii() and c.isalnum() else f"_{ord(c):x}"
    b = "".join(map(code, term[:2]))
    return F.col("bucket") == b


def matching(index: DataFrame, terms: list[str], key: str = "qid") -> DataFrame:
    """(key): the texts that hold a word for every term. One pass over the postings, counted by the term's place."""
    if not terms:
        return index.select(key).limit(0)
    hit = F.array_compact(F.array(*[F.when(prune(t) & holds_term(t), F.lit(i)) for i, t in enumerate(terms)]))
    any_hit = F.lit(False)
    for t in terms:
        any_hit = any_hit | (prune(t) & holds_term(t))
    got = index.filter(any_hit).select(key, F.explode(hit).alias("i"))
    return got.groupBy(key).agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(terms)).select(key)


def hits(index: DataFrame, terms: list[str], key: str = "qid") -> DataFrame:
    """(key, got): a bit for each term of which a text holds a word. One pass over the postings of the terms' buckets."""
    any_hit, mask = F.lit(False), F.lit(0)
    for i, t in enumerate(terms):
        hit = prune(t) & holds_term(t)
        any_hit = any_hit | hit
        mask = mask + F.when(hit, F.lit(1 << i)).otherwise(0)
    return index.filter(any_hit).groupBy(key).agg(F.bit_or(mask).alias("got"))


def search(q: DataFrame, r: DataFrame, c: DataFrame, request: SearchRequest, index: DataFrame | None = None) -> DataFrame:
    """(base, topper, paper, score, n_hits, place): the copies a query finds, a page of them.

    q: questions, r: refs, c: copies, index: postings(q), read from a stored index where there is one. The terms that start a
    word of a copy's name are taken off the query, and all others must be in one of its questions; a name hit outranks any
    number of questions. The index is read once, whatever parts of the query names take off: which terms a question holds
    is kept as bits, and a copy asks for its own. Texts are read for an exact phrase only, and only those the index leaves.
    """
    terms = request.terms
    if not terms:
        return c.limit(0).select("base", "topper", "paper", F.lit(0).alias("score"), F.lit(0).alias("n_hits"), F.lit(0).alias("place"))
    for k, v in request.facets.items():
        c = c.filter(F.col(k) == v)
    found = _matched(q, r, c, terms, request.mode, postings(q) if index is None else index)
    top = found.orderBy(F.desc("score"), "topper", "paper", "base").limit(request.page * PAGE)
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "topper", "paper", "base")))
    return ranked.filter(F.col("place") > (request.page - 1) * PAGE)


def _matched(q: DataFrame, r: DataFrame, c: DataFrame, terms: list[str], mode: str, index: DataFrame) -> DataFrame:
    """(base, topper, paper, score, n_hits): all copies that a query finds."""
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a query of more than {MOST_TERMS} words")
    every = (1 << len(terms)) - 1
    name = F.lower(F.coalesce("topper", F.lit("")))
    covered = F.lit(0)
    for i, t in enumerate(terms):
        covered = covered + F.when(T.starts_word(name, t), F.lit(1 << i)).otherwise(0)
    asks = c.select("base", "topper", "paper", (F.lit(every) - covered).alias("needed"))
    meets = r.select("qid", "base").distinct().join(hits(index, terms), "qid").join(asks.select("base", "needed"), "base").filter((F.col("needed") != 0) & (F.col("needed").bitwiseAND(F.col("got")) == F.col("needed")))
    if mode == "exact":
        rest = F.array_compact(F.array(*[F.when(F.col("needed").bitwiseAND(F.lit(1 << i)) != 0, F.lit(t)) for i, t in enumerate(terms)]))
        phrase = F.concat(F.lit(" "), F.array_join(rest, " "))
        meets = meets.join(q.select("qid", "text"), "qid").filter(F.contains(T.words_in_row(F.lower("text")), phrase))
    n = meets.groupBy("base").agg(F.count_distinct("qid").alias("n_hits"))
    j = asks.join(n, "base", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    score = F.when(F.col("needed") != every, F.lit(NAME_SCORE).cast("long")).otherwise(F.lit(0)) + F.col("n_hits")
    return j.filter((F.col("n_hits") > 0) | (F.col("needed") == 0)).select("base", "topper", "paper", score.alias("score"), "n_hits")


def totals(q: DataFrame, r: DataFrame, c: DataFrame, request: SearchRequest, index: DataFrame | None = None) -> DataFrame:
    """(n_copies, n_named, n_questions): over all pages how many copies a query finds, how many by name, and how many matching questions they have."""
    for k, v in request.facets.items():
        c = c.filter(F.col(k) == v)
    f = _matched(q, r, c, request.terms, request.mode, postings(q) if index is None else index)
    return f.agg(F.count(F.lit(1)).alias("n_copies"), F.count_if(F.col("score") >= NAME_SCORE).alias("n_named"), F.coalesce(F.sum("n_hits"), F.lit(0)).alias("n_questions"))


#: Longest query and longest facet value that an address may hold. Fixed values.
MOST_QUERY, MOST_FACET = 200, 60


def request_of(params: dict[str, str]) -> SearchRequest:
    """The request an address states (q, mode, paper, topper, source, page): texts are cut to their greatest length, unknown modes and pages are the first."""
    facets = {k: params[k][:MOST_FACET] for k in ("paper", "topper", "source") if params.get(k)}
    page = params.get("page", "1")
    return SearchRequest(params.get("q", "")[:MOST_QUERY], "exact" if params.get("mode") == "exact" else "all", facets, int(page) if page.isdigit() and int(page) else 1)


#: Orders of the questions view: by newest year, best rank, text, or how many copies answer.
ORDERS = {"year": ("-newest", "best"), "air": ("best", "-n_refs"), "name": (), "refs": ("-n_refs",)}


def sorted_by(names: tuple[str, ...]) -> list[Column]:
    """Columns of an order; a name after a hyphen goes down."""
    return [F.desc(n[1:]) if n.startswith("-") else F.col(n) for n in names]


def questions_view(q: DataFrame, r: DataFrame, c: DataFrame, request: SearchRequest, order: str = "refs", index: DataFrame | None = None) -> DataFrame:
    """(qid, paper, text, n_refs, best, newest, place): the questions that hold a query's terms and that one of the copies left by the facets
    answers, with only those answers counted; a page of them.

    c: copies with air and year (null or 0 where unknown). best is the least rank (1e9 if none is known), newest the latest year.
    """
    if request.terms:
        got = hits(postings(q) if index is None else index, request.terms)
        q = q.join(got.filter(F.col("got") == (1 << len(request.terms)) - 1).select("qid"), "qid", "left_semi")
        if request.mode == "exact":
            q = q.filter(T.has_phrase(F.lower("text"), request.terms))
    for k, v in request.facets.items():
        c = c.filter(F.col(k) == v)
    best = F.min(F.coalesce(F.nullif("air", F.lit(0)), F.lit(1_000_000_000)))
    n = r.select("qid", "base").distinct().join(c.select("base", "air", "year"), "base").groupBy("qid").agg(F.count(F.lit(1)).alias("n_refs"), best.alias("best"), F.max(F.coalesce("year", F.lit(0))).alias("newest"))
    by = sorted_by((*ORDERS[order], "text", "paper"))
    top = q.join(n, "qid").select("qid", "paper", "text", "n_refs", "best", "newest").orderBy(*by).limit(request.page * PAGE)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*by))).filter(F.col("place") > (request.page - 1) * PAGE)


#: Folders of a stored index.
SHELVES = 32


def build(rows: DataFrame, copies: DataFrame, path: str, stamp: str) -> None:
    """Writes the index of a corpus: postings by shelf (a hash of their bucket), sorted by bucket and token, so that a query reads one shelf
    per term and within it one stretch; the questions, where they stand, the copies; and a stamp that names this build in every table."""
    q = questions(rows)
    shelf = F.pmod(F.xxhash64("bucket"), F.lit(SHELVES)).cast("int")
    p = postings(q).withColumn("shelf", shelf).withColumn("stamp", F.lit(stamp))
    p.repartition(SHELVES, "shelf").sortWithinPartitions("shelf", "bucket", "token").write.partitionBy("shelf").parquet(f"{path}/postings")
    for name, df in (("questions", q), ("refs", refs(rows)), ("copies", copies)):
        df.withColumn("stamp", F.lit(stamp)).write.parquet(f"{path}/{name}")


class Stored:
    """A stored index: its tables, and the postings of a query's terms only."""

    def __init__(self, spark, path: str) -> None:
        read = lambda n: spark.read.parquet(f"{path}/{n}")
        self.all, self.questions, self.refs, self.copies = (read(n) for n in ("postings", "questions", "refs", "copies"))
        self.path = path

    def of(self, terms: list[str]) -> DataFrame:
        """The shelves of the terms' buckets; the shelf is a literal, so that others are not listed."""
        spark = self.all.sparkSession
        code = lambda c: c if c.isascii() and c.isalnum() else f"_{ord(c):x}"
        buckets = sorted({"".join(map(code, t[:2])) for t in terms})
        if not buckets:
            return self.all.limit(0)
        shelves = spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(b)), F.lit(SHELVES)).cast("int") for b in buckets])).first()[0]
        return self.all.filter(F.col("shelf").isin(*sorted(set(shelves))) & F.col("bucket").isin(*buckets))

    def stamps(self) -> DataFrame:
        """(stamp, n_tables): an index is whole if all of its tables have one stamp."""
        tables = (self.all, self.questions, self.refs, self.copies)
        one = [t.select("stamp").distinct().withColumn("t", F.lit(i)) for i, t in enumerate(tables)]
        return one[0].union(one[1]).union(one[2]).union(one[3]).groupBy("stamp").agg(F.count(F.lit(1)).alias("n_tables"))
