"""Shares are met, nothing is used too often, and rounding keeps what it must."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pustaka.llm.mixing import mix, round_copies, share_report

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("missing", 0.0, 1)]


def docs(n=3000):
    rng = random.Random(4)
    return [(i, rng.choice("aaaaabbc"), rng.choice([rng.randrange(1, 50), rng.randrange(200, 900)])) for i in range(n)] + [(n + 1, None, 10), (n + 2, "other", 10), (n + 3, "a", 0), (n + 4, "b", None)]


def test_shares(spark):
    s = spark.createDataFrame(docs(), "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m = mix(s, t)
    rep = {r["source"]: r for r in share_report(m, t).collect()}
    for name, share, most in TARGETS[:3]:
        assert rep[name]["actual_share"] == pytest.approx(share, abs=0.005)
        assert rep[name]["most_copies"] <= most
    assert m.filter("source NOT IN ('a', 'b', 'c')").count() == 0
    assert m.count() == sum(1 for d in docs() if d[1] in ("a", "b", "c"))


def test_rounding_keeps_tokens_and_chances(spark):
    rng = random.Random(9)
    rows = [(i, "s" if i % 3 else "hot", rng.randrange(1, 300), 0.37) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, p double").repartition(16)
    got = round_copies(df).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2000)) and {r["extra"] for r in got} <= {0, 1}
    for s in ("s", "hot"):
        kept = sum(r["n_tokens"] * r["extra"] for r in got if r["source"] == s)
        assert abs(kept - 0.37 * sum(x[2] for x in rows if x[1] == s)) <= 300
    share = [0] * 3
    for seed in range(4):
        for r in round_copies(df, seed).collect():
            share[r["n_tokens"] // 101] += r["extra"]
    many = [4 * sum(1 for x in rows if x[2] // 101 == k) for k in range(3)]
    assert all(abs(a / b - 0.37) < 0.06 for a, b in zip(share, many, strict=True))


def test_empty(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    assert mix(empty, t).count() == 0
    assert share_report(mix(empty, t), t).agg(F.count(F.lit(1))).first()[0] == len(TARGETS)
