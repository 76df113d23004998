"""Columns over texts, names and URLs: keys, hashes, tokens and the parts of each. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes two texts one, and what a query matches, depends on them.
NUMBER_LEAD = r"(?i)^\s*(?:Q(?:uestion)?\.?\s*)?\d{1,3}\s*[.):\-]*\s+"
DISPLAY_LEAD = r"(?i)^\s*(?:Q(?:uestion)?\.?\s*)?\d{1,3}[.):\-]?\s+"
PART_LEAD = r"(?i)^\s*\(?[a-e]\)?[).:]\s+"
LIMIT_TAIL = r"(?i)\s*\(\s*(?:answer\s+in\s+)?\d{1,4}\s*(?:words?|marks?)\s*\)\s*$"
MARKS_TAIL = r"\s*\(\s*\d{1,3}\s*\)\s*$"
KEY_LENGTH, BUCKET_LENGTH = 110, 60
FNV_START, FNV_PRIME, DJB_START = 2166136261, 16777619, 5381
PAPERS = ("GS1", "GS2", "GS3", "GS4", "Essay", "Other")

_NOT_WORD = r"[^\p{L}\p{N}]+"
_WORD = r"[\p{L}\p{M}\p{N}]+"


def blank(c: Column) -> Column:
    """Null as ''."""
    return F.coalesce(c, F.lit(""))


def norm(c: Column) -> Column:
    """A text for comparison: without its number and part letter, in lower case, with one space between runs of letters and digits."""
    x = F.regexp_replace(F.regexp_replace(blank(c), NUMBER_LEAD, ""), PART_LEAD, "")
    return F.trim(F.regexp_replace(F.lower(x), _NOT_WORD, " "))


def q_key(c: Column) -> Column:
    """The key under which lists kept by hand name a question: as norm, without a closing limit, cut to KEY_LENGTH."""
    x = F.regexp_replace(F.regexp_replace(blank(c), NUMBER_LEAD, ""), PART_LEAD, "")
    x = F.regexp_replace(F.regexp_replace(x, LIMIT_TAIL, ""), MARKS_TAIL, "")
    return F.substring(F.trim(F.regexp_replace(F.lower(x), _NOT_WORD, " ")), 1, KEY_LENGTH)


def name_key(c: Column) -> Column:
    """A name for comparison."""
    return F.trim(F.regexp_replace(F.lower(blank(c)), _NOT_WORD, " "))


def display(c: Column) -> Column:
    """A question without its leading number."""
    return F.regexp_replace(blank(c), DISPLAY_LEAD, "")


def slug(c: Column, fallback: str = "x") -> Column:
    """Lower-case ASCII letters and digits with hyphens between."""
    s = F.regexp_replace(F.regexp_replace(F.lower(blank(c)), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def _meta(c: Column, pattern: str) -> Column:
    x = F.trim(F.regexp_extract(blank(c), pattern, 1))
    x = F.regexp_replace(x, r"^[\[(]|[\])]$", "")
    return F.trim(F.regexp_replace(x, r"(?i)\s*(?:marks|words)\s*$", ""))


def meta_words(c: Column) -> Column:
    """The word limit of a metadata text, as it is written."""
    return _meta(c, r"(?i)Word limit:\s*([^,]*)")


def meta_marks(c: Column) -> Column:
    """The marks of a metadata text, as they are written."""
    return _meta(c, r"(?i)Marks:\s*(.*)$")


def paper_of(c: Column) -> Column:
    """The fixed paper a subject names in whatever case and spacing, or Optional."""
    key = F.lower(F.trim(blank(c)))
    out = F.lit("Optional")
    for p in PAPERS:
        out = F.when(key == p.lower(), p).otherwise(out)
    return F.when(key == "", "Other").otherwise(out)


def url_base(c: Column) -> Column:
    """A URL, trimmed, without its fragment."""
    return F.substring_index(F.trim(blank(c)), "#", 1)


def url_fragment(c: Column) -> Column:
    """What follows the first # of a URL, or ''."""
    return F.when(F.instr(blank(c), "#") > 0, F.regexp_replace(F.trim(c), r"^[^#]*#", "")).otherwise("")


def url_host(c: Column) -> Column:
    """The host of a URL in lower case without www., or ''."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(blank(c)), r"(?i)^[a-z][a-z0-9+.\-]*://([^/?#:]*)", 1)), r"^www\.", "")


def file_rank(c: Column) -> Column:
    """The rank a file name gives as rank_N, or null."""
    return F.regexp_extract(F.element_at(F.split(url_base(c), "/"), -1), r"(?i)(?:^|[-_ .])rank[-_ ]?(\d{1,3})(?!\d)", 1).try_cast("int")


def file_air(c: Column) -> Column:
    """The rank a file name gives as AIR-N, or null."""
    return F.regexp_extract(F.element_at(F.split(url_base(c), "/"), -1), r"(?i)AIR[-_ ]?(\d{1,3})(?!\d)", 1).try_cast("int")


def _codes(c: Column) -> Column:
    return F.transform(F.filter(F.split(blank(c), ""), lambda x: x != ""), F.ascii)


def fnv32(c: Column) -> Column:
    """FNV-1a of 32 bits over the code points of a text."""
    return F.aggregate(_codes(c), F.lit(FNV_START).cast("long"), lambda h, x: (h.bitwiseXOR(x.cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def djb32(c: Column) -> Column:
    """The xor form of djb2 of 32 bits over the code points of a text."""
    return F.aggregate(_codes(c), F.lit(DJB_START).cast("long"), lambda h, x: (h * F.lit(33).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).bitwiseXOR(x.cast("long")))


def copy_id(url: Column) -> Column:
    """48 bits of a URL in base 36: its FNV-1a, then the upper half of its djb2."""
    return F.lower(F.conv((fnv32(url) * 65536 + F.shiftright(djb32(url), 16)).cast("string"), 10, 36))


def index_tokens(c: Column) -> Column:
    """The words of a text for the index; the letters of dotted abbreviations are no words."""
    x = F.regexp_replace(F.lower(blank(c)), r"(^|[^\p{L}\p{M}\p{N}])\p{L}\.(?=\p{L}\.|\s)", "$1 ")
    return F.regexp_extract_all(x, F.lit(f"({_WORD})"), 1)


def query_terms(text: str) -> list[str]:
    """The words of a query."""
    import regex

    return regex.findall(_WORD, text.lower())


def bucket_key(token: Column) -> Column:
    """The first two characters of a token, others than a-z and 0-9 as _ and their code in hexadecimal."""
    return F.array_join(F.transform(F.filter(F.split(F.substring(token, 1, 2), ""), lambda x: x != ""), lambda x: F.when(x.rlike("^[a-z0-9]$"), x).otherwise(F.concat(F.lit("_"), F.lower(F.hex(F.ascii(x)))))), "")


def starts_word(text: Column, term: str) -> Column:
    """Whether a term of letters and digits starts a word of a lower-case text; a single letter must be a word of its own."""
    if len(term) > 1:
        return text.rlike(rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){term}")
    end = "" if term.isdigit() else r"\."
    return text.rlike(rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){term}(?![\p{{L}}\p{{M}}\p{{N}}{end}])")


def words_in_row(text: Column) -> Column:
    """The words of a lower-case text with one space before each."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(text, F.lit(f"({_WORD})"), 1), " "))


def has_phrase(text: Column, terms: list[str]) -> Column:
    """Whether the terms stand side by side among the words of a lower-case text; the last may be the start of a word."""
    return F.contains(words_in_row(text), F.lit(" " + " ".join(terms)))
