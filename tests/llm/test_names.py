"""Spellings of invented persons are linked, those of different persons are not."""

from __future__ import annotations

import math
import random
import re

from pustaka.llm import names as module
from pustaka.llm.names import NAME_SIM, _edit1, _pairs_of_keys, followed, links, name_pairs, name_sim, persons, similar_tokens

FIRST = ["Chandrika", "Amarnath", "Gurpreet", "Vasundhara", "Balachandra", "Nirmala"]
SYL = ["bha", "ko", "zu", "ri", "the", "mo", "ghi", "pa", "shu", "ve", "lo", "ji", "dhe", "na"]


def variants(first, middle, last, rng):
    full = f"{first} {middle} {last}" if middle else f"{first} {last}"
    k = rng.randrange(2, len(last) - 2)
    typo = last[:k] + last[k + 1] + last[k] + last[k + 2 :]
    out = [full, full.upper(), full.lower(), full.replace(" ", "_"), full.replace(" ", ""), f"Dr. {full}", f"{full} (Rank 12)", f"{full} UPSC Topper", f"{full} AIR 7", f"{last}, {first}", f"{first[0]}. {last}", f"{first} {typo}", f"{first[:4]} {last}", f"{last} {first}"]
    return list(dict.fromkeys(out)), full


def test_linking(spark):
    rng = random.Random(7)
    who, rows = {}, []
    for _ in range(60):
        last = "".join(rng.sample(SYL, 4)).title()
        names, full = variants(rng.choice(FIRST), rng.choice([None, None, rng.choice(FIRST)]), last, rng)
        for n in names:
            who[n] = last
            rows += [(n, "clash")] * (5 if n == full else 1)
    rows += [(None, "x"), ("Unknown", "x"), ("", "x"), ("  ", "x"), ("-", "x"), ("A" * 3000, "x")]
    df = spark.createDataFrame(rows, "topper string, name string")
    got = {(r["a"], r["b"]) for r in name_pairs(df).collect()}
    names = sorted(who)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if who[a] == who[b]}
    assert all(a < b for a, b in got)
    assert len(got & want) >= 0.97 * len(want)
    assert len(got & want) >= 0.99 * len(got)
    p = {r["name"]: r["n"] for r in persons(df).collect()}
    assert set(p) == set(who) | {"A" * 3000} and sum(p.values()) == len(rows) - 5


def test_similar_tokens_against_all_pairs(spark):
    rng = random.Random(3)
    base = {"".join(rng.sample(SYL, 4)) for _ in range(60)}
    tokens = set(base)
    for t in base:
        k = rng.randrange(1, len(t) - 1)
        tokens |= {t[:k] + t[k + 1 :], t[:k] + "x" + t[k + 1 :], t[:k] + t[k] + t[k:], t[: k - 1] + t[k] + t[k - 1] + t[k + 1 :]}
    got = {(r["ta"], r["tb"]) for r in similar_tokens(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    ts = sorted(tokens)
    want = {(a, b) for i, a in enumerate(ts) for b in ts[i + 1 :] if _edit1(a, b)}
    assert want <= got


def test_empty(spark):
    empty = spark.createDataFrame([], "topper string")
    assert name_pairs(empty).count() == 0 and persons(empty).count() == 0


def test_one_typo_in_many_names(spark):
    """A spelling error that stands in 3, 6 or 60 names is one of the right spelling, however many names share it."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.sample(SYL, n)).title()
    firsts = sorted({word(3) for _ in range(70)})[:64]
    rows = [f"{rng.choice(firsts)} {word(4)}" for _ in range(640)]
    want = set()
    for n, last in ((3, "Qazthimbore"), (6, "Wexpolandri"), (60, "Yuktrabsime")):
        wrong = last[:5] + last[6] + last[5] + last[7:]
        for f in firsts[:n]:
            rows += [f"{f} {last}", f"{f} {wrong}"]
            want.add(tuple(sorted((f"{f} {last}", f"{f} {wrong}"))))
    got = {(r["a"], r["b"]) for r in name_pairs(spark.createDataFrame([(r,) for r in rows], "topper string")).collect()}
    assert want <= got


def test_short_tokens_are_compared_exactly(spark):
    pairs = [("agnes", "aenes"), ("salim", "saim"), ("imran", "imlan"), ("asha", "ahsa")]
    got = {(r["ta"], r["tb"]) for r in similar_tokens(spark.createDataFrame([(t,) for p in pairs for t in p], "token string")).collect()}
    assert {tuple(sorted(p)) for p in pairs} <= got


def test_a_chain_of_hubs_is_followed_to_its_end(spark):
    hub = spark.createDataFrame([(i, min(i + 1, 40)) for i in range(41)], "x long, hub long")
    assert {r["hub"] for r in followed(hub).collect()} == {40}


def test_blocks_of_a_common_key_give_all_pairs(spark):
    rows = [(1, i) for i in range(57)] + [(2, i) for i in range(50, 60)] + [(3, 5)]
    got = [(r["ca"], r["cb"]) for r in _pairs_of_keys(spark.createDataFrame(rows, "key long, cid long"), block=10).collect()]
    want = {(a, b) for b in range(57) for a in range(b)} | {(a, b) for b in range(50, 60) for a in range(50, b)}
    assert len(got) == len(want) and set(got) == want


def test_links_against_all_pairs(spark):
    """A first letter misread in a common name, or a rare part that one name leaves out, loses no link."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.sample(SYL, n))
    firsts = ["amarnath", "gurpreet", "nirmala"]
    names = {tuple(sorted((rng.choice(firsts), word(4)))) for _ in range(150)}
    names |= {("bmarnath", "qazthimbore"), ("amarnath", "qazthimbore"), ("gurpreet", "nirmala"), tuple(sorted(("gurpreet", "nirmala", "zukoribha"))), ("j", "thepashu"), tuple(sorted(("jilomori", "t")))}
    names = sorted(names)
    rows = [(i, list(n)) for i, n in enumerate(names)]
    got = {(r["ca"], r["cb"]): r["sim"] for r in links(spark.createDataFrame(rows, "cid long, tokens array<string>")).collect()}
    count = {t: sum(t in n for n in names) for n in names for t in n}
    alike = lambda x, y: len(x) > 3 and len(y) > 3 and _edit1(x, y)
    most = {t: max(c for x, c in count.items() if x == t or alike(x, t)) for t in count}
    weight = lambda n: [math.log((len(names) + 1) / most[t]) if len(t) > 1 else 1.0 for t in n]
    want = {(i, j) for j, b in enumerate(names) for i, a in enumerate(names[:j]) if name_sim(list(a), list(b), weight(a), weight(b)) >= NAME_SIM}
    at = {n: i for i, n in enumerate(names)}
    assert tuple(sorted((at["amarnath", "qazthimbore"], at["bmarnath", "qazthimbore"]))) in want
    assert set(got) == want


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """Only the list of common keys may be: Spark expects far too few rows of the others, and 4,000,000 submissions filled the driver's memory."""
    plans, cut = [], module.cut

    def seen(df, *name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *name)

    monkeypatch.setattr(module, "cut", seen)
    df = spark.createDataFrame([(n,) for n in ("Amarnath Qazthimbore", "AMARNATH QAZTHIMBORE", "A. Qazthimbore", "Nirmala Wexpolandri")], "topper string")
    seen(name_pairs(df)).count()
    joins = [x for p in plans for x in p.splitlines() if "Join" in x]
    assert len(joins) > 10
    assert not [x for x in joins if "Broadcast" in x and not re.search(r"\[key#\d+L?\], \[key#\d+L?\], LeftOuter", x)]
