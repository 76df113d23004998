"""Results per key against a plain loop, with one key that holds most rows."""

from __future__ import annotations

import datetime as dt
import random

from pustaka.operators.hot_keys import heavy_keys, keyed, number_rows, per_key

SCHEMA = "submission_id long, coaching string, subject string, submitted_at timestamp, prov string, n long, pos string"


def rows(n: int):
    rng = random.Random(2)
    at = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        c = " Hot " if i % 3 else rng.choice(["a", "B", None, "", "c"])
        t = None if i % 50 == 0 else at + dt.timedelta(seconds=rng.randrange(5000))
        out.append((i, c, rng.choice(["x", "Y "]), t, rng.choice(["m", "o", None]), 1, "clash"))
    return out


def by_hand(data, field):
    groups = {}
    for r in data:
        k = r[1 if field == "coaching" else 2]
        if k is not None:
            groups.setdefault(k.strip().lower(), []).append((r[3] is not None, r[3] or dt.datetime.min, r[0], r[4] or ""))
    out = {}
    for k, g in groups.items():
        g.sort()
        gaps = [int((b[1] - a[1]).total_seconds()) for a, b in zip(g, g[1:], strict=False) if a[0] and b[0]]
        runs = []
        for x in g:
            if runs and runs[-1][0] == x[3]:
                runs[-1][1] += 1
            else:
                runs.append([x[3], 1])
        out[k] = (len(g), max(gaps, default=None), len(runs), max(n for _, n in runs))
    return out


def test_against_a_loop(spark):
    data = rows(900)
    df = spark.createDataFrame(data, SCHEMA)
    want = {(f, k): v for f in ("coaching", "subject") for k, v in by_hand(data, f).items()}
    for chunk in (7, 100, 100000):
        got = {(r["field_name"], r["key_value"]): (r["n_rows"], r["max_gap_s"], r["n_runs"], r["longest_run"]) for r in per_key(df, chunk_rows=chunk, ranges=5).collect()}
        assert got == want


def test_numbers_are_exact(spark):
    df = spark.createDataFrame(rows(500), SCHEMA)
    k = number_rows(keyed(df, ("coaching",), "submitted_at", "submission_id", "prov"), 6).collect()
    for key in {r["key_value"] for r in k}:
        own = sorted((r["pos"], r["at"] is not None, r["at"] or dt.datetime.min, r["row_id"]) for r in k if r["key_value"] == key)
        assert [p for p, *_ in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_heavy_and_empty(spark):
    df = spark.createDataFrame(rows(300), SCHEMA)
    assert {(r[0], r[1]) for r in heavy_keys(per_key(df), 300).collect()} >= {("coaching", "hot"), ("subject", "x"), ("subject", "y")}
    assert per_key(spark.createDataFrame([], SCHEMA)).count() == 0
