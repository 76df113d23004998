"""The LSH forest against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np

from pustaka.llm import near_duplicates as N
from pustaka.llm.near_duplicates import similar_groups, similar_pairs

COMMON = ["discuss", "the", "role", "of", "water", "policy", "in", "hill", "towns", "and", "its", "effect", "on", "weavers", "since", "reform", "with", "examples", "from", "plains", "coast", "trade", "health"]
SCHEMA = "submission_id long, question string, h long, toks string, n int"


def brute(rows, least=10):
    sets = {i: set(re.findall(r"[^\W_]+", (q or "").lower())) for i, q in rows}
    ids = [i for i in sorted(sets) if len(sets[i]) >= least]
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}


def data(spark, rows):
    return spark.createDataFrame([(i, q, 0, "clash", 1) for i, q in rows], SCHEMA)


def families(rng, n, names):
    out = []
    for _ in range(n):
        base = [*rng.sample(COMMON, 14), *(f"name{rng.randrange(10**6)}" for _ in range(names))]
        for _ in range(rng.randrange(1, 6)):
            v = list(base)
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(v))
                v[k : k + 1] = rng.choice([[], [v[k][:-1] + "x"], [v[k], rng.choice(COMMON)], [rng.choice(COMMON)]])
            rng.shuffle(v)
            out.append(" ".join(v).title() + rng.choice(["?", ". (150 words)", ""]))
    return out


def test_with_rare_words(spark):
    texts = families(random.Random(1), 120, 5)
    rows = list(enumerate(texts)) + [(9001, None), (9002, ""), (9003, "too short"), (9004, texts[0]), (9005, texts[0]), (9006, "बाढ़ " * 3)]
    got = {(r["a"], r["b"]) for r in similar_pairs(data(spark, rows)).collect()}
    assert got == brute(rows)


def test_without_rare_words(spark):
    rng = random.Random(2)
    rows = list(enumerate(" ".join(rng.sample(COMMON, 15)) for _ in range(500)))
    want = brute(rows)
    got = {(r["a"], r["b"]) for r in similar_pairs(data(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_a_third_are_copies_and_a_text_is_very_long(spark):
    rng = random.Random(3)
    hot = "Explain how dams on the upper river changed farming, fishing and trade in seven delta towns"
    rows = [(i, hot) for i in range(60)] + [(100 + i, t) for i, t in enumerate(families(rng, 40, 6))]
    rows += [(900, " ".join(f"w{i}" for i in range(30000))), (901, " ".join(f"w{i}" for i in range(29000)))]
    got = {(r["a"], r["b"]) for r in similar_pairs(data(spark, rows)).collect()}
    assert got == brute(rows) and (900, 901) in got


def test_large_stretches(spark, monkeypatch):
    """With small bounds, orders are cut deeper where neighbours differ, and stretches of many alike texts are compared in blocks."""
    monkeypatch.setattr(N, "SMALL", 6)
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "RARE", 2)
    rng = random.Random(6)
    base = [*COMMON[:20], *(f"term{k}" for k in range(12))]
    dense = [" ".join(w for i, w in enumerate(base) if i not in (a, b)) for a in range(12) for b in range(a)]
    rows = list(enumerate(dense + [" ".join(rng.sample(COMMON, 15)) for _ in range(150)]))
    want = brute(rows)
    sets = N.cut(N.word_sets(data(spark, rows), "submission_id", "question"), "sets")
    seen = []
    forest = N.cut
    monkeypatch.setattr(N, "cut", lambda df, name: seen.append((name, forest(df, name))) or seen[-1][1])
    links = N.similar_sets(sets).count()
    assert seen[0][0] == "neighbours" and seen[0][1].filter("stretch IS NOT NULL").count() > 0
    got = {(r["a"], r["b"]) for r in similar_pairs(data(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and links > 1000


def test_neighbours_of_a_sorted_order(monkeypatch):
    """A stretch of one place is cut by longest common prefix until it is small: texts that share two words of the order meet, those that share none do not."""
    monkeypatch.setattr(N, "SMALL", 4)
    m = 12
    tail = np.zeros((m, N.TAIL), ">u4")
    tail[:, 0], tail[:, 1], tail[:, 2] = np.repeat([1, 2], 6), np.repeat([1, 2, 3, 4], 3), np.arange(m)
    parity = np.array([2**40 - 1 if i % 3 == 1 else 0 for i in range(m)], np.uint64)
    out = N._neighbours(np.ones(m, np.uint64), tail, np.arange(m), parity, np.full(m, 30), np.zeros(m, np.int64))
    got = set(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert got == {(0, 2), (3, 5), (6, 8), (9, 11)}


def test_groups(spark):
    rows = list(enumerate(families(random.Random(4), 60, 5)))
    pairs = brute(rows)
    up = {i: i for i, q in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["group_id"] for r in similar_groups(data(spark, rows)).collect()}
    assert got == {i: root(i) for i in got} and {x for p in pairs for x in p} <= set(got)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similar_pairs(empty).count() == 0 and similar_groups(empty).count() == 0
