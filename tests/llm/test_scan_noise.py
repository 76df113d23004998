"""Noise put into known texts is found, and the checked texts come back."""

from __future__ import annotations

import re

from conftest import DATA

from pustaka.llm.scan_noise import _close_forms, _hash, anagram_hash, noise, repaired
from pyspark.sql import functions as F

SCHEMA = "ocr_id long, unit_key string, source string, paper string, page int, question string, kind string, n int"
BODY = ["Discuss the storage of surface water\nin the schools of hill districts.", "Explain how the schools share water\nand storage with hill districts now.", "Describe storage of water in schools\nof the hill districts since then."]


def rows():
    out = []
    for k in range(60):
        out.append((k, f"alpha-ias:{k // 6}", "Alpha IAS", "GS1", 3 + k % 6, f"Alpha IAS Mains Test Series - GS1\n{BODY[k % 3]}\n- {3 + k % 6} -" if k % 6 < 5 else f"{BODY[k % 3]}", "clash", 1))
    out += [
        (100, "alpha-ias:1", "Alpha IAS", "GS1", 9, "Alpha IAS Mains Test Series - GS1\nDiscuss the stor-\nage of surfacc water in scbools\nof hill dis-\nALPHA ias Mains Test Series - GS1   9\ntricts -\nsince 1ong.", "x", 1),
        (101, "alpha-ias:1", None, None, None, "12", "x", 1),
        (102, None, None, None, None, None, "x", 1),
        (103, "beta:1", "Beta", "GS2", 4, "", "x", 1),
        (104, "beta:1", "Beta", "GS2", 4, "Page 4 of 9\nWhy?\n" + "water in schools " * 5000, "x", 1),
    ]
    return out


def test_found(spark):
    got = {}
    for r in noise(spark.createDataFrame(rows(), SCHEMA)).collect():
        got.setdefault(r["ocr_id"], set()).add((r["line_no"], r["kind"]))
    assert got[100] == {(1, "header"), (2, "hyphen"), (3, "misread"), (4, "hyphen"), (5, "header")}
    assert got[104] == {(1, "pageno")}
    assert all(got.get(k) == ({(1, "header"), (4, "pageno")} if k % 6 < 5 else None) for k in range(60))
    assert not {101, 102, 103} & set(got)


def test_repaired(spark):
    got = {r["ocr_id"]: r["text"] for r in repaired(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got[100] == "Discuss the storage of surface water in schools of hill districts - since 1ong."
    assert got[0] == "Discuss the storage of surface water in the schools of hill districts."
    assert got[103] == "" and 102 not in got


def test_checked_texts_come_back(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    q, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("ocr_questions", "ocr_labels"))
    got = {r["ocr_id"]: r["text"] for r in repaired(q).collect()}
    flat = lambda t: re.sub(r"\s+", " ", t).strip()
    want = [(r["ocr_id"], flat(r["clean_text"])) for r in lab.join(q.filter("question IS NOT NULL").select("ocr_id"), "ocr_id").collect() if r["clean_text"]]
    assert sum(flat(got[i]) == t for i, t in want) >= 0.95 * len(want)


def test_two_faults_and_confusions_that_are_not_known(spark):
    usual = "communities districts policies finance disaster bridges irrigation villages"
    texts = [f"{usual} {usual}"] * 20 + ["The cornrnunities of two d1stricts", "new pol1cies on f1nance", "d1saster struck br1dges", "v1llages need irrigat1on", "the comrnunitics here"]
    df = spark.createDataFrame([(i, f"alpha:{i}", None, None, None, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["ocr_id"]: r["text"] for r in repaired(df).collect()}
    assert [got[20 + k] for k in range(5)] == ["The communities of two districts", "new policies on finance", "disaster struck bridges", "villages need irrigation", "the communities here"]
    assert all(got[k] == texts[k] for k in range(20))
    assert {(r["ocr_id"], r["kind"]) for r in noise(df).collect()} == {(20 + k, "misread") for k in range(5)}


def test_forms_of_a_large_booklet_meet_its_headers_in_blocks(spark):
    heads = spark.createDataFrame([("u", "alpha mains test"), ("v", "beta mains test")], "unit_key string, head string")
    odd = spark.createDataFrame([("u", f"alpha ma{c}ns test") for c in "abcdefgh"] + [("u", "beta mains tesd"), ("v", "beta mains tesd"), ("w", "alpha mains test")], "unit_key string, form string")
    got = {(r["unit_key"], r["form"]) for r in _close_forms(odd, heads, block=3).collect()}
    assert got == {("u", f"alpha ma{c}ns test") for c in "abcdefgh"} | {("v", "beta mains tesd")}


def test_hash(spark):
    words = ["schools", "scbools", "†ime", "p!ce"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(anagram_hash(F.col("w"))).collect()]
    assert got == [_hash(w) for w in words]
    assert _hash("scbools") - _hash("schools") == _hash("b") - _hash("h")


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert noise(empty).count() == 0 and repaired(empty).count() == 0
