"""Known answers of the text functions."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pustaka.functions import pages as P
from pustaka.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (T.norm, "Q.12) Discuss river-linking. (150 words)", "discuss river linking 150 words"),
        (T.norm, "Q. 7 (b) Examine the role of canals", "examine the role of canals"),
        (T.norm, "2024 was dry. Discuss.", "2024 was dry discuss"),
        (T.norm, "भारत में जल", "भ रत म जल"),
        (T.norm, None, ""),
        (T.q_key, "Q.12) Discuss river-linking. (150 words)", "discuss river linking"),
        (T.slug, "--Étude: Part 1!", "tude-part-1"),
        (T.slug, "", "x"),
        (T.index_tokens, "E.g. the e-governance plan, i.e. U.N. rules", ["g", "the", "e", "governance", "plan", "e", "n", "rules"]),
        (T.index_tokens, "plan B. end", ["plan", "end"]),
        (T.fnv32, "GS1|hello", 3950555898),
        (T.copy_id, "https://a.example/x.pdf", "1w94zhd8u0"),
        (T.copy_id, "https://b.example/y.pdf", "dmpej1gj5"),
        (T.meta_words, "Type: question, Word limit: 150 words, Marks: 10", "150"),
        (T.meta_marks, "Word limit: , Marks: [15]", "15"),
        (T.paper_of, " gs2 ", "GS2"),
        (T.paper_of, "Botany", "Optional"),
        (T.bucket_key, "água", "_e1g"),
        (T.url_host, "HTTPS://www.A.example:80/x", "a.example"),
    ],
)
def test_known_answers(spark, column, value, want):
    assert one(spark, column, value) == want


@pytest.mark.parametrize(
    ("text", "term", "want"),
    [("cooperative-federalism", "feder", True), ("bioethics", "ethics", False), ("e.g. rule", "e", False), ("plan e rule", "e", True), ("part 2. rest", "2", True)],
)
def test_starts_word(spark, text, term, want):
    assert one(spark, lambda c: T.starts_word(F.lower(c), term), text) is want


def test_phrase_may_end_within_a_word(spark):
    assert one(spark, lambda c: T.has_phrase(F.lower(c), ["judicial", "activ"]), "Judicial, activism today")


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="abcXYZ éभा.-(), ", min_size=1, max_size=40).filter(lambda s: s[0].isalpha()))
def test_norm_is_idempotent(spark, value):
    once = one(spark, T.norm, "zz " + value)
    assert one(spark, T.norm, once) == once


def test_lines_from_items(spark):
    items = [(10.0, 100.0, "right"), (1.0, 101.0, "left"), (1.0, 50.0, "below"), (5.0, 49.0, "it")]
    df = spark.createDataFrame([(items,), (None,)], "items array<struct<x:double,y:double,str:string>>")
    assert [r[0] for r in df.select(P.lines_from_items(F.col("items"))).collect()] == [["left right", "below it"], []]


def test_chunks(spark):
    assert one(spark, P.chunks, "1. One? || Two (10)\n2) Three 15 marks") == ["1. One?", "Two (10)", "2) Three 15 marks"]
