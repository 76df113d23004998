"""Noise in text from scanned pages: broken words, misread characters, running headers and page numbers.

Words. The anagram hash of a word is the sum of the fifth powers of its characters' numbers, so a misreading, as `rn`
for `m`, moves it by the same difference in every word. Rare words are joined in SQL with the frequent words whose hash
lies one such difference away, the matches are verified at the place of the misreading, and each rare word is corrected
to its most frequent match. To the confusions known beforehand come those that the corpus shows, and a word may hold two.
All counts are taken over the whole corpus.

Lines. A page number is recognised by its form. A running header is a line that comes back beside different
questions of one booklet; with digits, the publisher's name and the paper taken out, headers of different booklets are one form, and a
form that comes back in its booklets on the whole is a header wherever it stands. Broken words are joined where the
next line of the question goes on; the joined word must not be rarer than the same word with a hyphen inside a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pustaka.session import cut

#: What a scanner reads, and what is printed. Fixed values.
MISREAD = (
    ("c", "e"), ("@", "a"), ("ri", "n"), ("5", "s"), ("†", "t"), ("!", "i"), ("0", "o"), ("1", "l"), ("cl", "d"), ("9", "g"), ("b", "h"),
    ("ii", "u"), ("rn", "m"), ("f", "t"), ("vv", "w"), ("h", "li"), ("m", "rn"), ("|", "l"), ("$", "s"),
)
#: A frequent word stands at least this often, and so many times as often as its misreading; less for one with a mark or digit inside.
FREQUENT, RATIO, RATIO_MARK = 3, 8, 1
#: Words shorter than this have no two faults.
LONG_WORD = 7
#: A confusion is learned from so many words, this share of all that differ in one place, and if it is so many times as frequent as its reverse.
LEARNED_LEAST, LEARNED_SHARE, LEARNED_RATIO = 5, 0.002, 4
#: Forms of a booklet that are compared with its headers in one task, and corrections up to which these are broadcast.
UNIT_BLOCK, MOST_BROADCAST = 20_000, 200_000
#: A form of line is a header if its booklets have it on so many questions on average, and it comes back so often in all.
RETURNS, LEAST_RETURNS = 1.5, 2
HYPHENS = "-‐¬­"

WORD = r"[\p{L}\p{M}\p{N}@†!|$]+"
_PAGE = r"(?i)^[\s\-–—~\[\](){}|.·•*]*(?:p(?:age|g)?[\s.\-:]*)?\p{Nd}{1,4}(?:\s*(?:of|/)\s*\p{Nd}{1,4})?[\s\-–—~\[\](){}|.·•*]*(?:page)?[\s|.]*$"
_NOTE = r"(?i)^[\s\[(]*(?:answer in\s*)?(?:\p{Nd}{1,4}\s*(?:words?|marks?|m)?[\s,.\])]*)+$"


def _words_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}]+", " "))


def _may_be_header(line: Column, words: Column) -> Column:
    """Some letters, no note on words or marks, and no end of a sentence or clause."""
    return (F.length(words) >= 6) & ~line.rlike(_NOTE) & ~line.rlike(r"[.?!।),;:]\s*$")


def _form(words: Column, names: list[tuple[Column, str]]) -> Column:
    """The words of a line with the names (of its publisher and paper) and single letters taken out."""
    x = F.concat(F.lit(" "), words, F.lit(" "))
    for n, mark in names:
        x = F.when(F.length(n) > 1, F.replace(x, F.concat(F.lit(" "), n, F.lit(" ")), F.lit(mark))).otherwise(x)
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?<= )\p{Ll}(?= )", " "), r"\s+", " "))


def _lines(df: DataFrame, row_id: str, text: str) -> DataFrame:
    return df.select(F.col(row_id).cast("long").alias("ocr_id"), F.split(F.col(text), "\n").alias("ls"), "unit_key", "source", "paper", "page").filter(F.col("ls").isNotNull())


def line_kinds(df: DataFrame, row_id: str = "ocr_id", text: str = "question") -> DataFrame:
    """(ocr_id, line_no, kind): the lines that belong to the page, header or pageno; lines are numbered from 1.

    Each line is looked at once. Of those that may be headers only the form and a hash of the longest other line beside it are kept, so that
    no text of a question is shuffled.
    """
    # names are put into words once a row, lines once each
    named = _lines(df, row_id, text).withColumns({"w_source": _words_only(F.coalesce("source", F.lit(""))), "w_unit": _words_only(F.coalesce(F.split_part("unit_key", F.lit(":"), F.lit(1)), F.lit(""))), "w_paper": _words_only(F.coalesce("paper", F.lit("")))})
    worded = named.withColumn("ws", F.transform("ls", lambda x: F.struct(x.alias("line"), _words_only(x).alias("words"))))
    feats = F.transform("ws", lambda e: F.struct(e["line"].alias("line"), e["words"].alias("words"), e["line"].rlike(_PAGE).alias("page_form"), _may_be_header(e["line"], e["words"]).alias("may"), F.length(e["line"]).alias("len"), F.xxhash64(e["line"]).alias("hash")))
    rows = worded.withColumn("feats", feats)
    # the longest lines, those that can be no header first; of a text's two, a line is beside the one that it is not
    by_length = F.array_sort(F.array_distinct(F.transform(F.filter("feats", lambda f: ~f["page_form"]), lambda f: F.struct(f["may"].alias("may"), (-f["len"]).alias("n"), f["hash"].alias("hash")))))
    two = rows.withColumn("longest", F.slice(by_length, 1, 2)).select("*", F.get("longest", F.lit(0))["hash"].alias("first"), F.get("longest", F.lit(1))["hash"].alias("second"))
    each = two.select("ocr_id", F.size("ls").alias("n_lines"), "first", "second", "unit_key", "w_source", "w_unit", "w_paper", "page", F.posexplode("feats").alias("pos", "f"))
    lines = each.select("*", (F.col("pos") + 1).alias("line_no"), F.col("f.line").alias("line")).filter((F.col("f.page_form") | F.col("f.may")) & (F.col("n_lines") > 1))
    bare = F.trim(F.col("line")).rlike(r"^\p{Nd}{1,4}$")
    number = F.translate(F.trim(F.col("line")), "०१२३४५६७८९০১২৩৪৫৬৭৮৯௦௧௨௩௪௫௬௭௮௯", "0123456789" * 3).try_cast("int")
    pageno = F.col("f.page_form") & (~bare | F.col("page").isNull() | (number == F.col("page")) | (F.col("line_no") < F.col("n_lines")))
    form = F.when(F.col("f.may"), _form(F.col("f.words"), [(F.col("w_source"), " S "), (F.col("w_unit"), " S "), (F.col("w_paper"), " P ")]))
    beside = F.when(F.col("f.hash") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    marked = cut(lines.select("ocr_id", "line_no", "unit_key", pageno.alias("pageno"), form.alias("form"), beside.alias("beside")).filter("pageno OR form IS NOT NULL"), "marked")
    may = marked.filter("NOT pageno AND form IS NOT NULL")
    # of a question asked twice in a booklet every line comes back, so what counts is how many different longest other lines a line has
    per_unit = may.filter("unit_key IS NOT NULL").groupBy("form", "unit_key").agg(F.count_distinct("beside").alias("rows"))
    forms = per_unit.groupBy("form").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("units"))
    heads = forms.filter((F.col("rows") >= RETURNS * F.col("units")) & (F.col("rows") - F.col("units") >= LEAST_RETURNS) & (F.length("form") >= 6)).select("form", F.lit(True).alias("known"))
    # a misread header is a few letters away from a header of its own booklet
    near = cut(may.select("form", "unit_key").distinct().join(heads, "form", "left"), "forms")
    odd = _close_forms(near.filter("known IS NULL AND unit_key IS NOT NULL AND length(form) >= 8").select("unit_key", "form"), near.filter("known AND unit_key IS NOT NULL").select("unit_key", F.col("form").alias("head")))
    found = may.join(heads.select("form"), "form", "left_semi").union(may.join(odd, ["form", "unit_key"], "left_semi").select("form", *[c for c in may.columns if c != "form"]))
    return marked.filter("pageno").select("ocr_id", "line_no", F.lit("pageno").alias("kind")).union(found.select("ocr_id", "line_no", F.lit("header").alias("kind")))


def _close_forms(odd: DataFrame, heads: DataFrame, block: int = UNIT_BLOCK) -> DataFrame:
    """(unit_key, form): the forms at most three letters away from a header of their booklet. The forms of a large booklet are dealt into
    blocks, which its few headers all meet."""
    many = odd.groupBy("unit_key").agg(F.count(F.lit(1)).alias("c")).select("unit_key", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    left = odd.join(many, "unit_key").withColumn("b", F.pmod(F.xxhash64("form"), F.col("blocks")).cast("int"))
    right = heads.join(many, "unit_key").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    j = left.select("unit_key", "b", "form").join(right.select("unit_key", "b", "head"), ["unit_key", "b"])
    return j.filter((F.abs(F.length("form") - F.length("head")) <= 3) & (F.levenshtein("form", "head", 3) >= 0)).select("unit_key", "form").distinct()


def content(df: DataFrame, kinds: DataFrame, row_id: str = "ocr_id", text: str = "question") -> DataFrame:
    """(ocr_id, c): for each text the lines that belong to the question, in order: (line_no, line, broken, rest, next_no, next_word).

    `broken`: its last word goes on in the next line of the question, which begins with next_word; `rest`: its first word is such a rest.
    """
    drop = kinds.groupBy("ocr_id").agg(F.collect_set("line_no").alias("drop"))
    rows = _lines(df, row_id, text).select("ocr_id", "ls").join(drop, "ocr_id", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    own = rows.select("ocr_id", F.filter(F.transform("ls", lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_replace(x, r"\s+$", "").alias("line"))), lambda e: ~F.array_contains(F.col("drop"), e["line_no"])).alias("own"))
    after = own.select("ocr_id", "own", F.transform("own", lambda e: F.regexp_extract(e["line"], f"^\\s*({WORD})", 1)).alias("heads"), F.transform("own", lambda e: e["line"].rlike(r"^\s*\p{L}")).alias("letters"))
    ends = after.select("*", F.transform("own", lambda e, i: e["line"].rlike(r"[\p{L}\p{M}][" + HYPHENS + "]$") & F.coalesce(F.get("letters", i + 1), F.lit(False))).alias("broken"))
    c = F.transform(
        "own",
        lambda e, i: F.struct(
            e["line_no"].alias("line_no"),
            e["line"].alias("line"),
            F.get("broken", i).alias("broken"),
            F.coalesce(F.get("broken", i - 1), F.lit(False)).alias("rest"),
            F.get("own", i + 1)["line_no"].alias("next_no"),
            F.when(F.get("broken", i), F.get("heads", i + 1)).alias("next_word"),
        ),
    )
    return ends.select("ocr_id", c.alias("c"))


def _core(word: Column) -> Column:
    """A word in lower case without the marks around it."""
    return F.regexp_replace(F.lower(word), r"^[!|$@†]+|[!|$]+$", "")


def words_of(c: DataFrame) -> DataFrame:
    """(ocr_id, line_no, next_no, head_len, word): the words of the content lines, a broken one joined and given to the line it begins in."""
    e = c.select("ocr_id", F.explode("c").alias("e")).select("ocr_id", "e.*")
    e = e.withColumn("tokens", F.regexp_extract_all(F.col("line"), F.lit(f"({WORD})"), 1))
    e = e.withColumn("w", F.when(F.col("rest"), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0)))).otherwise(F.col("tokens")))
    last = F.when(F.col("broken") & (F.size("w") > 0), F.array(F.struct(F.length(F.element_at("w", -1)).alias("head_len"), F.concat(F.element_at("w", -1), F.coalesce("next_word", F.lit(""))).alias("word")))).otherwise(F.array().cast("array<struct<head_len:int,word:string>>"))
    whole = F.transform(F.when(F.col("broken"), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).otherwise(F.col("w")), lambda x: F.struct(F.lit(0).alias("head_len"), x.alias("word")))
    return e.select("ocr_id", "line_no", "next_no", F.explode(F.concat(whole, last)).alias("x")).select("ocr_id", "line_no", "next_no", "x.head_len", _core(F.col("x.word")).alias("word")).filter("word <> ''")


def anagram_hash(word: Column) -> Column:
    """The sum of the fifth powers of the numbers of a word's characters; characters beyond ASCII take numbers below 256."""
    number = lambda c: F.when(F.ascii(c) < 128, F.ascii(c)).otherwise(F.ascii(c) % 128 + 128).cast("long")
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a + F.when(c == "", F.lit(0)).otherwise(number(c) * number(c) * number(c) * number(c) * number(c)))


def _hash(s: str) -> int:
    return sum((ord(c) if ord(c) < 128 else ord(c) % 128 + 128) ** 5 for c in s)


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n, whole, h): how often each word stands, how often of these unbroken, and its hash."""
    v = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("head_len") == 0).alias("whole"))
    return cut(v.filter(F.length("word") >= 3).withColumn("h", anagram_hash(F.col("word"))), "vocabulary")


def _frequent(vocab: DataFrame) -> DataFrame:
    return vocab.filter((F.col("n") >= FREQUENT) & F.col("word").rlike(r"^\p{Ll}+$") & (F.length("word") >= 4)).select(F.col("word").alias("right"), F.col("n").alias("m"), F.col("h").alias("key"))


def _enough(strict: int = 1) -> Column:
    """Whether the right word is frequent enough beside the misread one."""
    ratio = F.when(F.col("word").rlike(r"[^\p{L}\p{M}]"), RATIO_MARK).otherwise(RATIO * strict)
    return F.col("m") >= F.greatest(ratio * F.col("n"), F.lit(FREQUENT))


def _confusions(pairs: list[tuple[str, str]]) -> Column:
    """The confusions whose misread side a word holds."""
    odd = [F.struct(F.lit(a).alias("read"), F.lit(b).alias("print"), F.lit(_hash(b) - _hash(a)).cast("long").alias("d")) for a, b in pairs]
    return F.filter(F.array(*odd), lambda o: F.contains(F.col("word"), o["read"]))


def _undone(word: Column, read: Column, printed: Column) -> Column:
    """What a word may have been: (at, word) for each place at which `read` stands, with what is printed put there."""
    at = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.length(read)) == read)
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.concat(F.substring(word, F.lit(1), i - 1), printed, F.substring(word, i + F.length(read), F.length(word))).alias("word")))


def _best(found: DataFrame) -> DataFrame:
    """The most frequent match of each word."""
    return found.groupBy("word").agg(F.max_by(F.struct("right", "at"), F.struct("m", "right")).alias("b"), F.first("n").alias("n")).select("word", "b.right", "b.at", "n")


def one_fault(vocab: DataFrame, frequent: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(word, right, at, n): the words that one confusion turns into a frequent one, and the place of the fault as an array."""
    keyed = vocab.select("word", "n", "h", F.explode(_confusions(pairs)).alias("o")).select("word", "n", "o.read", "o.print", (F.col("h") + F.col("o.d")).alias("key"))
    near = keyed.join(frequent, "key").filter(_enough())
    at = F.transform(F.filter(_undone(F.col("word"), F.col("read"), F.col("print")), lambda x: x["word"] == F.col("right")), lambda x: x["at"])
    return _best(near.withColumn("at", F.slice(at, 1, 1)).filter("size(at) > 0"))


def two_faults(vocab: DataFrame, frequent: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(word, right, at, n): the words of at least LONG_WORD characters that two confusions turn into a frequent one, and the places of both."""
    has = _confusions(pairs)
    both = F.flatten(F.transform(has, lambda x: F.transform(F.filter(has, lambda y: y["read"] >= x["read"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    keyed = vocab.filter(F.length("word") >= LONG_WORD).select("word", "n", "h", F.explode(both).alias("o")).select("word", "n", "o", (F.col("h") + F.col("o.x.d") + F.col("o.y.d")).alias("key"))
    near = keyed.join(frequent, "key").filter(_enough(2))
    first = _undone(F.col("word"), F.col("o.x.read"), F.col("o.x.print"))
    places = F.flatten(F.transform(first, lambda a: F.transform(F.filter(_undone(a["word"], F.col("o.y.read"), F.col("o.y.print")), lambda b: b["word"] == F.col("right")), lambda b: F.array_sort(F.array(a["at"], b["at"])))))
    return _best(near.withColumn("at", F.get(places, F.lit(0))).filter("at IS NOT NULL"))


def learned(vocab: DataFrame, frequent: DataFrame) -> list[tuple[str, str]]:
    """Confusions of one character that the corpus shows: what parts rare words from frequent ones at one place, again and again and far
    more often that way than the other; endings are left out, as words are inflected there. At most 1 / LEARNED_SHARE of them can be."""
    hidden = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.struct(F.xxhash64(F.concat(F.substring(c, F.lit(1), i - 1), F.lit("\u0001"), F.substring(c, i + 1, F.length(c)))).alias("key"), F.substring(c, i, F.lit(1)).alias("ch"))))
    rare = vocab.filter(F.length("word") >= 5).select("word", "n", hidden(F.col("word")).alias("k")).select("word", "n", "k.key", F.col("k.ch").alias("read"))
    full = frequent.filter(F.length("right") >= 5).select("right", "m", hidden(F.col("right")).alias("k")).select("m", "k.key", F.col("k.ch").alias("print"))
    seen = rare.join(full, "key").filter(F.col("read") != F.col("print")).filter(F.col("m") >= RATIO * F.col("n")).groupBy("read", "print").agg(F.count_distinct("word").alias("c"))
    back = seen.select(F.col("read").alias("print"), F.col("print").alias("read"), F.col("c").alias("back"))
    all_pairs = seen.agg(F.sum("c").alias("all"))
    ok = seen.join(back, ["read", "print"], "left").crossJoin(F.broadcast(all_pairs)).filter((F.col("c") >= LEARNED_LEAST) & (F.col("c") >= LEARNED_SHARE * F.col("all")) & (F.col("c") >= LEARNED_RATIO * F.coalesce("back", F.lit(0))))
    return sorted((r["read"], r["print"]) for r in ok.select("read", "print").collect())


def corrections(vocab: DataFrame) -> DataFrame:
    """(word, right, at, n): for each misread word its correction, and where its misreadings begin.

    Known confusions come first; those learned from what they leave over come second, and two in one word last.
    """
    frequent = cut(_frequent(vocab), "frequent")
    known = cut(one_fault(vocab, frequent, list(MISREAD)), "known")
    rest = cut(vocab.join(known, "word", "left_anti"), "rest")
    more = [p for p in learned(rest, frequent) if p not in MISREAD]
    if more:
        fresh = cut(one_fault(rest, frequent, more), "fresh")
        known, rest = known.union(fresh), rest.join(fresh, "word", "left_anti")
    return known.union(two_faults(rest, frequent, [*MISREAD, *more]))


def _joined_by(words: DataFrame, fixes: DataFrame) -> DataFrame:
    """The words with their corrections. These are broadcast if they are few by count, as every word of the corpus stands on the other side."""
    return words.join(F.broadcast(fixes) if fixes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else fixes, "word")


def _parts(df: DataFrame, row_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines of the page with their kinds, content by text, the broken lines whose hyphen belongs to the word, and the misread words with their corrections."""
    kinds = cut(line_kinds(df, row_id, text), "kinds")
    c = cut(content(df, kinds, row_id, text), "content")
    w = cut(words_of(c), "words")
    e = c.select("ocr_id", F.explode("c").alias("e")).select("ocr_id", "e.*")
    inside = e.filter(F.contains("line", F.lit("-"))).select(F.explode(F.regexp_extract_all(F.lower("line"), F.lit(r"(\p{L}+-\p{L}+)"), 1)).alias("hyphened")).groupBy("hyphened").agg(F.count(F.lit(1)).alias("n"))
    whole = F.lower(F.concat(F.regexp_extract("line", r"(\p{L}+)[" + HYPHENS + "]$", 1), F.lit("-"), F.regexp_extract("next_word", r"^(\p{L}+)", 1)))
    real = e.filter("broken").select("ocr_id", "line_no", whole.alias("hyphened")).join(inside, "hyphened").withColumn("joined", F.replace("hyphened", F.lit("-"), F.lit("")))
    vocab = vocabulary(w)
    known = vocab.select(F.col("word").alias("joined"), F.col("whole").alias("k"))
    compound = cut(real.join(known, "joined", "left").filter(F.col("n") > F.coalesce("k", F.lit(0))).select("ocr_id", "line_no"), "compounds")
    bad = _joined_by(w, cut(corrections(vocab), "corrections"))
    return kinds, c, compound, bad


def noise(df: DataFrame, row_id: str = "ocr_id", text: str = "question") -> DataFrame:
    """(ocr_id, line_no, kind): one row for each line and kind of noise in it.

    Null texts have no lines, an empty one has one without noise; a text of one line has neither header nor page number;
    repeated rows count for each other's headers only within their booklet; an empty table gives an empty result. Only
    the columns row_id, text, unit_key, source, paper and page are read. A booklet that holds most rows is spread like any
    others: its lines are counted by form, and compared with its headers in blocks.
    """
    kinds, c, compound, bad = _parts(df, row_id, text)
    hyphen = c.select("ocr_id", F.explode(F.filter("c", lambda e: e["broken"])).alias("e")).select("ocr_id", "e.line_no").join(compound, ["ocr_id", "line_no"], "left_anti").select("ocr_id", "line_no", F.lit("hyphen").alias("kind"))
    at = bad.select("ocr_id", "line_no", "next_no", "head_len", F.explode("at").alias("at"))
    misread = at.select("ocr_id", F.when((F.col("head_len") > 0) & (F.col("at") > F.col("head_len")), F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("kind"))
    return reduce(DataFrame.union, (kinds, hyphen, misread.distinct()))


def plain_text(df: DataFrame, row_id: str = "ocr_id", text: str = "question") -> DataFrame:
    """(ocr_id, text): each text without the lines of the page and with broken words joined; line feeds between its lines stay. A text of page
    lines only is empty; no filter on it here, which would be pushed below and have the lines looked at twice."""
    c = content(df, cut(line_kinds(df, row_id, text), "kinds"), row_id, text)
    piece = lambda e: F.when(e["broken"], F.regexp_replace(e["line"], "[" + HYPHENS + "]$", "")).otherwise(F.concat(e["line"], F.lit("\n")))
    return c.select("ocr_id", F.array_join(F.transform("c", piece), "").alias("text"))


def _apply(line: Column, fixes: Column) -> Column:
    """A line with its misread words replaced, in the case of their first letter."""

    def one(acc: Column, f: Column) -> Column:
        wrong, right = f["word"], f["right"]
        upper = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
        x = F.regexp_replace(acc, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), wrong, F.lit(r"\E(?![\p{L}\p{N}])")), right)
        return F.regexp_replace(x, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), upper(wrong), F.lit(r"\E(?![\p{L}\p{N}])")), upper(right))

    return F.aggregate(fixes, line, one)


def repaired(df: DataFrame, row_id: str = "ocr_id", text: str = "question") -> DataFrame:
    """(ocr_id, text): each question as continuous text, without lines of the page, with broken words joined and misread ones corrected."""
    _, c, compound, bad = _parts(df, row_id, text)
    keep = compound.groupBy("ocr_id").agg(F.collect_set("line_no").alias("keep"))
    fixes = bad.groupBy("ocr_id").agg(F.collect_set(F.struct("word", "right")).alias("fixes"))
    held = lambda e: F.coalesce(F.array_contains("keep", e["line_no"]), F.lit(False))
    piece = lambda e: F.when(e["broken"] & ~held(e), F.regexp_replace(e["line"], "[" + HYPHENS + "]$", "")).when(e["broken"], e["line"]).otherwise(F.concat(F.trim(e["line"]), F.lit(" ")))
    joined = c.filter(F.size("c") > 0).join(keep, "ocr_id", "left").select("ocr_id", F.trim(F.regexp_replace(F.array_join(F.transform("c", piece), ""), r"\s+", " ")).alias("text"))
    return joined.join(fixes, "ocr_id", "left").select("ocr_id", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(_apply(F.col("text"), F.col("fixes"))).alias("text"))
