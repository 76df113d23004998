"""No piece is lost or divided, no container too full, and few containers are used."""

from __future__ import annotations

import random
from collections import defaultdict

from pustaka.llm.packing import best_fit, crossover, evolution_report, evolve, fill_report, mutate, pack

PACKS = [("small", 100), ("large", 1000)]


def run(spark, sizes, **kw):
    s = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    p = spark.createDataFrame(PACKS, "pack_name string, capacity_tokens int")
    return pack(s, p, **kw), p


def test_every_piece_lies_in_one_container(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 400), 100, 1000])) for i in range(400)] + [(900, 0), (901, None), (902, 12345)]
    df, packs = run(spark, sizes, block=60)
    bins, docs = defaultdict(int), defaultdict(list)
    for r in df.collect():
        bins[r["pack_name"], r["container_id"]] += r["n_tokens"]
        docs[r["pack_name"], r["doc_id"]].append((r["part_no"], r["n_tokens"]))
    for name, cap in PACKS:
        assert max(v for (n, _), v in bins.items() if n == name) <= cap
        for i, n in sizes:
            parts = sorted(docs[name, i])
            assert sum(x for _, x in parts) == (n or 0) and [k for k, _ in parts] == list(range(1, len(parts) + 1))
            assert len(parts) == max(1, -(-(n or 0) // cap))
    for r in fill_report(df, packs).collect():
        assert r["containers"] <= 1.05 * r["least_containers"] + 3


def test_operators_keep_the_pieces():
    rng = random.Random(2)
    size = [rng.randrange(1, 70) for _ in range(120)]
    a = best_fit([], list(range(120)), size, 100)
    b = best_fit([], sorted(range(120), key=lambda i: rng.random()), size, 100)
    for child in (crossover(a, b, size, 100, rng), mutate(a, size, 100, rng), evolve(size, 100, [a], 5)):
        assert sorted(i for x in child for i in x) == list(range(120))
        assert all(sum(size[i] for i in x) <= 100 for x in child)
    assert len(evolve(size, 100, [], 5)) <= len(a)


def test_evolution_beats_a_poor_start():
    size = [34, 33, 33] * 40 + [51, 49] * 30
    poor = [[i] for i in range(len(size))]
    assert len(evolve(size, 100, [poor], 3, generations=25)) <= 74


def test_evolution_beats_best_fit():
    """On sizes of which three fill a bin exactly best fit wastes a bin in seven; on many small blocks it wastes one now and then."""
    rng = random.Random(5)
    for n in (40, 60, 120):
        size = []
        for _ in range(n):
            a = rng.randrange(380, 490)
            b = rng.randrange(250, (1000 - a) // 2 + 1)
            size += [a, b, 1000 - a - b]
        plain = len(best_fit([], list(range(len(size))), size, 1000))
        assert n <= len(evolve(size, 1000, [], 3)) <= 0.93 * plain
    plain = evolved = 0
    for k in range(24):
        size = [min(2047, int(2 ** rng.uniform(4, 11))) for _ in range(400)]
        plain += len(best_fit([], list(range(400)), size, 2048))
        evolved += len(evolve(size, 2048, [], k))
    assert evolved < plain


def test_report_of_the_evolution(spark):
    rng = random.Random(8)
    sizes = spark.createDataFrame([(i, rng.randrange(1, 99)) for i in range(300)], "doc_id long, n_tokens long")
    got = evolution_report(sizes, spark.createDataFrame(PACKS, "pack_name string, capacity_tokens int"), block=60).collect()
    assert sum(r["n_pieces"] for r in got) == 600
    assert all(r["least_bins"] <= r["evolved_bins"] <= r["best_fit_bins"] for r in got)


def test_empty_and_repeated(spark):
    assert run(spark, [])[0].count() == 0
    df, _ = run(spark, [(1, 40), (1, 40), (2, 30)])
    assert df.filter("pack_name = 'small'").count() == 3
