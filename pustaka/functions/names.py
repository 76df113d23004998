"""Columns over names, subjects and file names, and the short forms in which texts are compared or shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pustaka.functions import text as T

# Fixed values.
CAPTION, RANK_CAPTION = r"(?i)\s+UPSC\b.*\bTopper\b.*$", r"(?i)\s+Rank$"
FILE_YEAR = r"(?<!\d)(20(?:1[5-9]|2[0-6]))(?!\d)"
FILE_TEST = r"(?i)^(?:[0-9a-f]+-)?\d+[_-](\d+)[_-]?(.*?)\.pdf$"
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def ascii_key(c: Column) -> Column:
    """The ASCII letters and digits of a name in lower case."""
    return F.regexp_replace(F.lower(T.blank(c)), r"[^a-z0-9]+", "")


def clean_name(c: Column) -> Column:
    """A name without the captions that file names put behind it."""
    return F.trim(F.regexp_replace(F.regexp_replace(T.blank(c), CAPTION, ""), RANK_CAPTION, ""))


def base_subject(c: Column) -> Column:
    """A subject without the number of its paper; General Studies papers are subjects of their own."""
    return F.when(F.startswith(c, F.lit("General Studies")), c).otherwise(F.regexp_replace(T.blank(c), r"\s+(?:I|II)$", ""))


def file_name(url: Column) -> Column:
    return F.element_at(F.split(decoded(T.url_base(url)), "/"), -1)


def file_year(url: Column) -> Column:
    """The year a file name gives, or null."""
    return F.regexp_extract(file_name(url), FILE_YEAR, 1).try_cast("int")


def file_test(url: Column) -> Column:
    """The number of the test a file name gives: the second number before the name, else the last of several numbers, or null."""
    fn = file_name(url)
    runs = F.regexp_extract_all(F.regexp_replace(fn, r"(?i)\.pdf$", ""), F.lit(r"(\d+)"), 1)
    return F.when(fn.rlike(FILE_TEST), F.regexp_extract(fn, FILE_TEST, 1)).when(F.size(runs) >= 2, F.element_at(runs, -1)).try_cast("long")


def file_person(url: Column) -> Column:
    """The name between the numbers of a file name and what follows it, or ''."""
    return F.regexp_replace(F.regexp_extract(file_name(url), r"(?i)^\d+[_-](.*?)\.pdf$", 1), r"(?i)[_-]+(?:rank.*|air.*|\d.*)$", "")


def decoded(c: Column) -> Column:
    """A percent-encoded text decoded, or as it is where it cannot be."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def short_key(c: Column, length: int) -> Column:
    """The first ASCII letters and digits of a text."""
    return F.substring(F.regexp_replace(F.lower(T.blank(c)), r"[^a-z0-9]", ""), 1, length)


def clip(c: Column, length: int) -> Column:
    """A text of at most `length` characters, the last an ellipsis where it was cut."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length - 1), F.lit("…"))).otherwise(c)


def html(c: Column) -> Column:
    """A text with the five characters of markup escaped."""
    x = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def script_json(c: Column) -> Column:
    """A JSON text that may stand in a script element."""
    return F.replace(c, F.lit("<"), F.lit("\\u003c"))


def base32_of_hex(c: Column) -> Column:
    """The first 40 bits of a hexadecimal digest in base 32."""
    n = F.conv(F.substring(c, 1, 10), 16, 10).cast("long")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(F.lit(BASE32), (F.call_function("shiftright", n, F.lit(35) - i * 5).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))), "")


def tags(*parts: Column) -> Column:
    """Descriptors in a row; those that are null are passed over."""
    return F.concat_ws(" · ", *parts)
