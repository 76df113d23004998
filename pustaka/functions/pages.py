"""Text of pages: lines from placed items, and questions from a page's lines or from one scanned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SAME_LINE, LOOK_BACK = 2.0, 7
NEW_QUESTION = r"\s*\|\|\s*|\n\s*(?=(?:Q(?:uestion)?\.?\s*)?\d{1,2}[.)]\s)"


def lines_from_items(items: Column) -> Column:
    """The lines of a page from its items (x, y, str): an item joins the latest of the last LOOK_BACK lines whose height is within
    SAME_LINE, else starts one; lines go from the top down and items from left to right. Null and empty pages have no lines."""
    part = "struct<y:double,parts:array<struct<x:double,s:string>>>"
    start = F.expr(f"cast(array() as array<{part}>)")

    def place(acc: Column, it: Column) -> Column:
        near = F.array_max(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(acc), F.lit(1))), lambda i: (i <= F.size(acc)) & (i > F.size(acc) - LOOK_BACK) & (F.abs(F.get(acc, i - 1)["y"] - it["y"]) <= SAME_LINE)), lambda i: i))
        one = F.array(F.struct(it["x"].alias("x"), it["str"].alias("s")))
        joined = F.transform(acc, lambda ln, i: F.when(i + 1 == near, F.struct(ln["y"].alias("y"), F.concat(ln["parts"], one).alias("parts"))).otherwise(ln))
        return F.when(near.isNotNull(), joined).otherwise(F.concat(acc, F.array(F.struct(it["y"].alias("y"), one.alias("parts")))))

    lines = F.aggregate(F.coalesce(items, F.expr("cast(array() as array<struct<x:double,y:double,str:string>>)")), start, place)
    ordered = F.array_sort(lines, lambda a, b: F.when(a["y"] > b["y"], -1).when(a["y"] < b["y"], 1).otherwise(0))
    text = F.transform(ordered, lambda ln: F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(ln["parts"]), lambda p: p["s"]), " "), r"\s+", " ")))
    return F.filter(text, lambda t: t != "")


def chunks(text: Column) -> Column:
    """The questions of a text that holds several: parted at || and where a line begins with a number."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), NEW_QUESTION), lambda t: F.trim(t)), lambda t: t != "")


def stated_marks(text: Column) -> Column:
    """The marks a question states in itself, or ''."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(\d{1,3})\s*(?:marks?|m)\b", 1), F.lit("")), F.regexp_extract(text, r"[\[(]\s*(\d{1,2})\s*[\])]\s*$", 1))


def stated_words(text: Column) -> Column:
    """The word limit a question states in itself, or ''."""
    return F.regexp_extract(text, r"(?i)(\d{2,3})\s*words?\b", 1)


#: Characters of a lead at most, and at least where it ends at a space. Fixed values.
LEAD, LEAST_LEAD = 250, 150


def lead_length(text: Column) -> Column:
    """Where a long text is cut: at the last space within its first LEAD characters, if that is not too near the start, else at LEAD."""
    head = F.substring(text, 1, LEAD + 1)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    return F.when((F.instr(head, " ") > 0) & (at >= LEAST_LEAD), at).otherwise(LEAD)
