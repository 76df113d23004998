"""Texts garbled on purpose come back; proper ones stay as they are."""

from __future__ import annotations

import pytest

from pustaka.llm.encoding_repair import ENCODINGS, TABLES, garbled, repair

TEXT = "The naïve reading — that cafés and co‑working rooms pay ₹240 — “ignores” what happened at 36°C. हाल के वर्षों में जल प्रबंधन। সাম্প্রতিক বছর। கடலோர பாதுகாப்பு"
PROPER = [
    "The sign ‘Ã’ and the letter ‘â’ are set in “Times”.",
    "The sign ‘Ã' and the letter ‘â' are set in 'Times'.",
    "JOÃO DE São Paulo, Ångström and naïveté, “România”, château, £50 or €43",
    "Привет, мир — это слово. Καλημέρα κόσμε.",
    TEXT,
    "plain ascii",
    "",
]


def garble(text: str, encoding: str) -> str:
    back = {b: c for c, b in TABLES[encoding].items()}
    return "".join(chr(b) if b < 128 else back[b] for b in text.encode())


@pytest.mark.parametrize("encoding", ENCODINGS)
def test_one_layer(encoding):
    bad = garble(TEXT, encoding)
    assert repair(bad)[0] == TEXT


def test_more_layers():
    bad = garble(garble(TEXT, "cp1252"), "cp1252")
    assert repair(bad)[:2] == (TEXT, 2)
    assert repair(garble(bad, "latin-1"))[0] == TEXT


def test_a_part_is_garbled():
    assert repair("Fine. " + garble("naïve — “so”", "cp850") + " and हाल fine — too.")[0] == "Fine. naïve — “so” and हाल fine — too."


@pytest.mark.parametrize("text", PROPER)
def test_proper_text_stays(text):
    assert repair(text) == (text, 0, 0)


def test_rows(spark):
    rows = [(1, garble(TEXT, "mac_roman"), 5), (2, TEXT, 5), (3, None, 5), (4, "", 5), (5, "caf�s", None), (6, garble(TEXT, "cp437") * 300, 1), (1, garble(TEXT, "mac_roman"), 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lost int")
    got = garbled(df).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 5, 6]
    assert {r["doc_id"]: (r["restored"], r["layers"] > 0, r["lost"]) for r in got} == {1: (TEXT, True, 0), 5: ("caf�s", False, 1), 6: (TEXT * 300, True, 0)}
    assert garbled(spark.createDataFrame([], "doc_id long, text string")).count() == 0
