"""Order-dependent operators against known answers and plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pustaka.functions import text as T
from pustaka.operators import classify as C
from pustaka.operators import dedupe as D
from pustaka.operators import entities as E
from pustaka.operators import index as I
from pustaka.operators import joins as J
from pustaka.operators import ranking as R
from pustaka.operators.aggregates import low_yield
from pustaka.operators.components import components
from pustaka.sources import sinks

B = "rivers shape the settlement pattern of the northern plains and"


def test_containment_fold(spark):
    texts = [B + " deltas", B, B + " deltas 2 it is easier to build", B + " hills"]
    df = spark.createDataFrame([("GS1", t) for t in texts], "paper string, norm string")
    host = {r["norm"]: r["host"] for r in D.contained(df).collect()}
    assert host == {texts[0]: texts[0], B: texts[2], texts[2]: texts[2], texts[3]: texts[3]}


def test_containment_against_a_loop(spark):
    import re

    rng = random.Random(12)
    tails = [" ".join(rng.choice(["deltas", "hills", "2 it", "q 7 towns", "ports", B]) for _ in range(rng.randrange(0, 5))) for _ in range(160)]
    texts = sorted({f"{B} {t}".strip()[: rng.randrange(60, 400)].strip() for t in tails} | {"short", B[:59], B[:60]})
    kept, want = [], {}
    for n in sorted(texts, key=lambda n: (-len(n), n)):
        at = next((k for k in kept if n[:60] == k[:60] and n in k and not re.match(r"\s*(?:q(?:uestion)? )?\d{1,2} ", k[k.index(n) + len(n) :])), None)
        if at is None:
            kept.append(n)
        want[n] = at or n
    got = {r["norm"]: r["host"] for r in D.contained(spark.createDataFrame([("GS1", t) for t in texts], "paper string, norm string")).collect()}
    assert got == want and len(set(want.values())) < len(want) - 20


def test_near_same():
    def same(a, b):
        w = [[x for x in dict.fromkeys(t.lower().split()) if len(x) > 2 and x not in D.STOP and not x.isdigit()] for t in (a, b)]
        return D.near_same(*w)

    assert same("Discuss aseismic structure design for earthquake prone hill towns", "Discuss aseismic structure design for earthquack prone hill towns")
    assert not same("Role of women in canal irrigation freedom movement campaigns", "Role of tribals in canal irrigation freedom movement campaigns")
    assert not same("Outcomes of the 28th climate session on river water finance", "Outcomes of the 29th climate session on river water finance")
    assert not same("river basin water policy", "river basin water policy reform")
    assert same("Explain river basin water policy reform", "Explain river basin water policy reform in coastal districts")


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(40)]
    base = [" ".join(rng.sample(vocab, 9)) for _ in range(25)]
    texts = set(base)
    for t in base:
        v = t.split(" ")
        texts |= {" ".join(v[:-2]), " ".join([v[0][:-1] + "x", *v[1:]]), " ".join([*v, "added"])}
    df = spark.createDataFrame([("P", t, 1) for t in texts], "paper string, norm string, n_refs int")
    got = {(r["a"], r["b"]) for r in D.near_pairs(df).collect()}
    ts = sorted(texts)
    want = {(a, b) for i, a in enumerate(ts) for b in ts[i + 1 :] if D.near_same(a.split(" "), b.split(" "))}
    assert got == want
    merged = D.near_merged(df).collect()
    assert len(merged) == len(texts)
    assert all((min(r["norm"], r["host"]), max(r["norm"], r["host"])) in want for r in merged if r["norm"] != r["host"])


def test_near_merge_keeps_questions_of_one_copy_apart(spark):
    t = "river basin water policy reform coastal"
    texts = [(t, 9, ["u1"]), (t + " districts", 5, ["u2", "u3"]), (t + " regions", 4, ["u3"]), (t + " towns", 3, ["u1"]), (t + " cities", 2, [""]), (t + " villages", 1, [""])]
    df = spark.createDataFrame([("P", n, k) for n, k, _ in texts], "paper string, norm string, n_refs int")
    refs = spark.createDataFrame([("P", n, u) for n, _, us in texts for u in us], "paper string, norm string, base string")
    host = {r["norm"][len(t) + 1 :]: r["host"][len(t) + 1 :] for r in D.near_merged(df, refs).collect()}
    # regions shares u3, which the first text gained from districts; towns shares u1 with the first text itself; no URL is no copy
    assert host == {"": "", "districts": "", "regions": "regions", "towns": "towns", "cities": "", "villages": ""}


def test_near_merge_takes_standalone_texts_left_by_containment(spark):
    from conftest import DATA

    from pustaka.plans import dedupe as P

    texts, refs = P._standalone(spark, DATA)
    kept = {(r["paper"], r["norm"]): r["n_refs"] for r in texts.collect()}
    rows = P.source_rows(spark, DATA)
    rows = rows.withColumn("norm", T.norm(F.col("question"))).withColumn("route", C.route(F.col("question"), F.col("marks"), F.col("words"), F.col("paper"))).collect()
    alone = [r for r in rows if r["norm"] and r["route"] == "question"]
    assert sum(kept.values()) == len(alone) < sum(r["norm"] != "" for r in rows)
    assert {(r["paper"], r["norm"]) for r in refs.collect()} == set(kept)
    copies = {}
    for r in refs.collect():
        copies.setdefault((r["paper"], r["norm"]), set()).add(r["base"])
    n = near_loop({k: (v, copies[k]) for k, v in kept.items()})
    assert {(r["paper"], r["host"]): r["n_members"] for r in P.near_duplicate_merge(spark, DATA).collect()} == n


def test_near_pairs_with_many_misspelt_words(spark):
    common = "river basin water policy reform coastal district climate"
    rare = ["zubhakomo", "ghivelojis", "thepashuri", "dhenamokob", "virilobhas"]
    a, b = f"{common} {' '.join(rare)}", f"{common} {' '.join(w[:-1] + 'x' for w in rare)}"
    rows = [("P", t) for t in (a, b, *(f"{common} filler{k} other{k}" for k in "abcdef"))]
    got = {(r["a"], r["b"]) for r in D.near_pairs(spark.createDataFrame(rows, "paper string, norm string")).collect()}
    assert D.near_same(a.split(" "), b.split(" ")) and (min(a, b), max(a, b)) in got


def test_full_candidates_hold_all_near_pairs(spark):
    from conftest import DATA

    from pustaka.plans import dedupe as P

    full = {(r["paper"], r["a"], r["b"]) for r in P.QUERIES["near_duplicate_candidates_full"](spark, DATA).collect()}
    ts = sorted((r["paper"], r["norm"]) for r in P._texts(spark, DATA).collect())
    words = {t: [w for w in dict.fromkeys(t[1].split(" ")) if len(w) > 2 and w not in D.STOP and not w.isdigit()] for t in ts}
    share = lambda a, b: 10 * len(set(words[a]) & set(words[b])) >= 3 * min(len(words[a]), len(words[b]))
    want = {(a[0], a[1], b[1]) for i, a in enumerate(ts) for b in ts[i + 1 :] if a[0] == b[0] and share(a, b) and (D.near_same(words[a], words[b]) or D.near_same(words[b], words[a]))}
    assert len(want) > 60 and want <= full
    assert {(r["paper"], r["a"], r["b"]) for r in D.near_pairs(P._texts(spark, DATA)).collect()} <= full


def near_loop(texts):
    """The rule in a plain loop over all texts. texts: (paper, norm) -> (number of references, copies)."""
    words = {k: [w for w in dict.fromkeys(k[1].split(" ")) if len(w) > 2 and w not in D.STOP and not w.isdigit()] for k in texts}
    kept, copies, n = [], {}, {}
    for k in sorted(texts, key=lambda k: (-texts[k][0], k[1])):
        own = texts[k][1] - {""}
        shared = [(-len(set(words[k]) & set(words[h])), i, h) for i, h in enumerate(kept) if h[0] == k[0]]
        ok = (h for s, _, h in sorted(shared) if -10 * s >= 3 * len(words[k]) and not own & copies[h] and D.near_same(words[k], words[h]))
        host = next(ok, k)
        if host == k:
            kept.append(k)
        copies.setdefault(host, set()).update(own)
        n[host] = n.get(host, 0) + 1
    return n


def test_components_against_union_find(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(0, k) for k in range(300, 420)] + [(k, k + 1) for k in range(500, 560)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slug_loop(slugs):
    taken, out = set(), []
    for s in slugs:
        new, k = s, 1
        while new in taken:
            k += 1
            new = f"{s}-{k}"
        taken.add(new)
        out.append(new)
    return out


def test_unique_slugs(spark):
    rng = random.Random(3)
    cases = [["a-b", "a-b", "a-b-2", "a-b"], ["a-b", "a-b", "a-b-2", "a-b-2"], ["a", "a", "a-2", "a-2", "b", "b", *["b" + "-2" * k for k in range(1, 13)]], [rng.choice(["x", "x-2", "x-2-2", "x-3", "y", "z-1"]) for _ in range(80)]]
    assert slug_loop(cases[0]) == ["a-b", "a-b-2", "a-b-2-2", "a-b-3"]
    for slugs in cases:
        df = spark.createDataFrame(list(enumerate(slugs)), "ord int, slug string")
        got = {r["ord"]: r["unique_slug"] for r in R.unique_slugs(df, "slug", "ord").collect()}
        assert [got[i] for i in range(len(slugs))] == slug_loop(slugs)


def test_round_robin(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, "C"), (6, "C")], "id int, host string")
    assert [r["id"] for r in R.round_robin(df, "host", "id").orderBy("slot").collect()] == [1, 4, 5, 2, 6, 3]


def test_places_number_all_rows(spark):
    df = spark.range(1000).withColumn("v", F.hash("id"))
    assert [r["place"] for r in R.places(df, ["v", "id"]).orderBy("v", "id").collect()] == list(range(1, 1001))


def test_ranges_against_a_loop(spark):
    df = spark.createDataFrame([(v,) for v in range(-5, 60, 3)], "v long")
    starts = spark.createDataFrame([(0, "a"), (10, "b"), (41, "c")], "start long, lab string")
    got = {r["v"]: r["lab"] for r in J.in_ranges(df, "v", starts, "start", "lab").collect()}
    assert got == {v: None if v < 0 else "a" if v < 10 else "b" if v < 41 else "c" for v in range(-5, 60, 3)}


def test_router(spark):
    cases = [
        ("What is Needed?", "", "GS1", "fragment"),
        ("What is Needed?", "10", "GS1", "question"),
        ("What is Needed?", "", "Essay", "question"),
        ("(a) ethical issues and the options open to the officer now", "5", "GS4", "part"),
        ("", "", "GS1", "fragment"),
    ]
    df = spark.createDataFrame(cases, "q string, m string, p string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", C.route(F.col("q"), F.col("m"), F.lit(""), F.col("p")).alias("got")).collect())


def test_classes(spark):
    nodes = spark.createDataFrame([("GS1", "n1", ["river", "basin"]), ("GS1", "n2", ["water policy"]), ("GS1", "n3", ["soil"]), ("GS2", "n4", ["river"])], "paper string, node_id string, kw array<string>")
    texts = spark.createDataFrame([(1, "GS1", "River basin, soil and water policy"), (2, "GS1", "soil only")], "key long, paper string, text string")
    assert [(r["key"], r["node_id"], r["score"]) for r in C.classes(texts, nodes).orderBy("place").collect()] == [(1, "n2", 12), (1, "n1", 10)]


def test_tokens_within_one(spark):
    names = spark.createDataFrame([("asha rao",), ("Rao Kiran M",), ("rao",), ("zz zz",)], "name string")
    persons = spark.createDataFrame([("Asha Devi Rao",), ("Kiran Rao",), ("Asha Rao",)], "person string")
    assert {r["name"]: r["person"] for r in E.tokens_within_one(names, persons).collect()} == {"asha rao": "Asha Rao", "Rao Kiran M": "Kiran Rao"}


def test_index_equals_scan(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["federal", "federalism", "e.g.", "e", "soil", "salinity", "भारत", "भार", "water-share"]) for _ in range(6)) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, text string")
    words = [set(r["t"]) for r in df.orderBy("qid").select(T.index_tokens(F.col("text")).alias("t")).collect()]
    index = I.postings(df)
    for terms in (["federal"], ["e"], ["sal", "water"], ["भार"], ["soil", "soil"]):
        got = {r["qid"] for r in I.matching(index, terms).collect()}
        assert got == {i for i, w in enumerate(words) if all(any(x.startswith(t) if len(t) > 1 else x == t for x in w) for t in terms)}


def test_parts_and_index_round_trip(spark, tmp_path):
    q = spark.createDataFrame([(i, "GS1" if i % 2 else "GS2", f"text {i}", f"Text {i}") for i in range(200)], "qid long, paper string, norm string, text string")
    refs = spark.createDataFrame([(i, f"https://a.example/{i % 17}") for i in range(200)], "qid long, base string")
    parts = sinks.with_parts(q, refs, part_bytes=300)
    sinks.write_parts(parts, str(tmp_path / "parts"))
    back = spark.read.parquet(str(tmp_path / "parts"))
    assert {(r["qid"], r["text"]) for r in back.collect()} == {(r["qid"], r["text"]) for r in q.collect()}
    assert sinks.manifest(parts).agg(F.sum("n_rows")).first()[0] == 200
    sinks.write_index(I.postings(q), str(tmp_path / "ix"))
    assert I.matching(spark.read.parquet(str(tmp_path / "ix")), ["text", "17"]).count() == I.matching(I.postings(q), ["text", "17"]).count() > 0


def test_low_yield(spark):
    df = spark.createDataFrame([("g", n) for n in (20, 22, 24, 5, 13)], "g string, n int")
    assert {r["n"]: (r["median"], r["low"]) for r in low_yield(df, "g", "n").collect()} == {n: (20.0, n == 5) for n in (20, 22, 24, 5, 13)}


def test_stored_index(spark, tmp_path):
    """A stored index gives what one made for the query gives, reads the shelves of the query's terms only, and is of one build."""
    from conftest import DATA

    from pustaka.operators import aggregates as A
    from pustaka.sources.corpus import source_rows

    rows = source_rows(spark, DATA)
    I.build(rows, A.copies(rows), str(tmp_path / "ix"), "one")
    ix = I.Stored(spark, str(tmp_path / "ix"))
    for request in (I.SearchRequest("feder grant"), I.SearchRequest("two sides", "exact"), I.SearchRequest("e", page=2), I.SearchRequest("")):
        want = I.search(I.questions(rows), I.refs(rows), A.copies(rows), request).collect()
        assert I.search(ix.questions, ix.refs, ix.copies, request, ix.of(request.terms)).collect() == want
    assert len(ix.of(["federal"]).inputFiles()) < len(ix.all.inputFiles()) or "shelf" in ix.of(["federal"])._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in ix.stamps().collect()] == [("one", 4)]


def test_requests_of_addresses():
    r = I.request_of({"q": "x" * 300, "mode": "exact", "paper": "GS1", "topper": "y" * 99, "page": "0"})
    assert (len(r.text), r.mode, r.facets["paper"], len(r.facets["topper"]), r.page) == (200, "exact", "GS1", 60, 1)
    assert I.request_of({"mode": "any"}) == I.SearchRequest("")


def test_maps_are_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([('a"b', 1, None), ("b", 2, "x\ny"), ("_note", 3, "z")], "name string, n int, t string")
    sinks.write_map(rows, "name", ["n", "t"], str(tmp_path / "m"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect())
    import json

    assert json.loads(text) == {'a"b': {"n": 1}, "b": {"n": 2, "t": "x\ny"}, "_note": {"n": 3, "t": "z"}}
    got = {(r["name"], r["n"], r["t"]) for r in sinks.read_map(spark, str(tmp_path / "m"), "name", "n int, t string").collect()}
    assert got == {('a"b', 1, None), ("b", 2, "x\ny")}
    assert sinks.read_map(spark, str(tmp_path / "none"), "name", "n int").count() == 0


def test_where_links_are_fetched_from(spark):
    cases = {
        "https://drive.google.com/file/d/AB_1/view?x": ("https://drive.google.com/uc?export=download&id=AB_1", "drive-file"),
        "https://drive.google.com/drive/u/0/folders/XY": (None, "drive-folder"),
        "https://drive.google.com/open?id=Q9&a=1": ("https://drive.google.com/uc?export=download&id=Q9", "drive-open"),
        "https://a.example/x.pdf": ("https://a.example/x.pdf", "direct"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", *J.fetched_from(F.col("u"), F.lit(None).cast("string")))
    assert {r["u"]: (r["fetch_url"], r["note"]) for r in df.collect()} == cases


def test_holders_against_all_pairs(spark):
    rng = random.Random(4)
    w = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    docs, items = [(i, w(rng.randrange(1, 60))) for i in range(80)], [(i, w(rng.randrange(1, 8))) for i in range(120)]
    items += [(500, docs[3][1]), (501, " ".join(docs[5][1].split(" ")[2:12]))]
    got = {(r["d"], r["i"]) for r in D.holders(spark.createDataFrame(docs, "d int, norm string"), spark.createDataFrame(items, "i int, norm string"), "d", "i").collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if len(x.split(" ")) >= 5 and f" {x} " in f" {t} "}


def test_alike_in_a_group_against_all_pairs(spark):
    rng = random.Random(9)
    vocab = [f"word{k}" for k in range(14)]
    rows = [(i, f"g{i % 2}", i % 3 if i % 7 else None, rng.sample(vocab, rng.randrange(1, 9))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, g string, page int, w array<string>")
    left, right = df.filter("id < 60"), df.filter("id >= 60")
    got = {r["id"] for r in R.alike_in_group(left, right, "g", "id", "page", "w", 0.6, 0.72).collect()}

    def alike(a, b):
        x, y = set(a[3]), set(b[3])
        least = 0.6 if a[2] is not None and a[2] == b[2] else 0.72
        return a[1] == b[1] and len(x & y) >= least * len(x | y) - 1e-9

    assert got == {a[0] for a in rows[:60] if any(alike(a, b) for b in rows[60:])} and 0 < len(got) < 60


def test_extracted_questions():
    from pustaka.functions.extract import question_text, questions_of

    assert question_text("Q.3) Discuss the role of rivers in towns. (150 words) Ans: They") == "Discuss the role of rivers in towns. (150 words)"
    assert question_text("Why did river towns grow so fast? Introduction") == "Why did river towns grow so fast?"
    assert question_text("Explain the growth of river towns. Introduction - they") == "Explain the growth of river towns"
    page = "1. Explain river towns in the plains\n2) Discuss water policy in hills\nQ3 Examine trade in the coast\nwith examples"
    assert list(questions_of(page)) == ["Explain river towns in the plains", "Discuss water policy in hills", "Examine trade in the coast with examples"]
    assert list(questions_of("Page 3\n\nDiscuss how the river towns of the plains grew\nin time?")) == ["Discuss how the river towns of the plains grew in time?"]
    assert list(questions_of("")) == [] and list(questions_of("no question here")) == []


def test_everything_merged_keeps_marks_years_and_copies(spark):
    t = "explain river basin water policy reform"
    rows = [
        (1, f"Q1. {t}", "", "", "GS1", "u1", "question", 2019),
        (2, f"{t}?", "10", "", "GS1", "u2", "question", 2020),
        (3, f"{t} in coastal districts", "", "150", "GS1", "u3", "question", None),
        (4, f"{t} in coastal districts and beyond", "15", "", "GS1", "u1", "question", 2021),
        (5, "so it was", "", "", "GS1", "u1", "fragment", 2021),
        (6, None, "", "", "GS1", "u1", "question", 2021),
    ]
    df = spark.createDataFrame(rows, "ord long, question string, marks string, words string, paper string, base string, kind string, year int")
    got = {(r["kind"], r["norm"]): (r["n_refs"], r["n_texts"], r["n_copies"], r["marks"], r["words"], r["years"]) for r in D.all_merged(df).collect()}
    assert sum(v[0] for v in got.values()) == 5 and got[("fragment", "so it was")] == (1, 1, 1, "", "", "2021")
    # the third lies in the fourth; that shares a copy with the first, and so is not merged into it
    assert got[("question", t)] == (2, 1, 2, "10", "", "2019,2020")
    assert got[("question", f"{t} in coastal districts and beyond")] == (2, 2, 2, "15", "150", "2021")


def test_close_words_against_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice(["ka", "bho", "ri", "zu", "the"]) for _ in range(rng.randrange(1, 6))) for _ in range(60)}
    for w in sorted(words):
        for _ in range(4):
            k, x = rng.randrange(len(w)), w
            for _ in range(rng.choice((1, 2))):
                k = rng.randrange(len(x) + 1)
                x = rng.choice((x[:k] + x[k + 1 :], x[:k] + "aé"[k % 2] + x[k:], x[:k] + "o" + x[k + 1 :]))
            words.add(x or "a")
    df = spark.createDataFrame([("p", w) for w in words], "paper string, word string")
    got = {(r["word"], r["as"]) for r in D.close_words(df, df).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and D._close(a, b)}


def test_candidates_do_not_grow_with_the_common_words(spark):
    """Texts on one pattern that differ in their rare words are no candidates, and a pair all of whose rare words are misspelt is one."""
    rng = random.Random(9)
    frame = "government should review policy impact across districts where farmers joined after reform".split()
    rare = lambda: ["".join(rng.choice("bdghklmnprstvz") + rng.choice("aeiou") for _ in range(5)) for _ in range(4)]
    rows = [" ".join(frame + rare()) for _ in range(200)]
    a = rare()
    b = [w[:2] + w[3:-1] + "y" + w[-1] for w in a]
    a, b = " ".join(frame + a), " ".join(frame + b)
    got = D.near_candidates(spark.createDataFrame([("GS1", x) for x in [*rows, a, b]], "paper string, norm string")).collect()
    assert (min(a, b), max(a, b)) in {(r["a"], r["b"]) for r in got} and len(got) < 2000


def test_word_candidates_shuffle_no_pairs(spark):
    """Blocks of texts give all pairs, and the plan groups no pairs."""
    rng = random.Random(4)
    texts = sorted({" ".join(rng.sample(["alpha", "bravo", "delta", "gamma", "kappa", "sigma", "theta", "omega", "zulu"], rng.randrange(5, 8)) + [f"tail{i % 7}x"]) for i in range(60)})
    df = spark.createDataFrame([("GS1", t) for t in texts], "paper string, norm string")
    got = D.word_candidates(df, block=9)
    share = lambda a, b: len(set(a.split()) & set(b.split()))
    want = {("GS1", a, b, share(a, b)) for i, a in enumerate(texts) for b in texts[i + 1 :] if 10 * share(a, b) >= 3 * min(len(a.split()), len(b.split()))}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def _joins_of(monkeypatch, run) -> list[str]:
    """The joins of the plans that `run` cuts and returns."""
    from pustaka.operators import components as K

    plans, cut = [], D.cut

    def seen(df, *name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *name)

    for module in (D, K):
        monkeypatch.setattr(module, "cut", seen)
    seen(run()).count()
    return [x for p in plans for x in p.splitlines() if "Join" in x]


MISSPELT = "the canal roads of northern vidhana reshaped farming markets and village credit for landless weavers"


def test_near_merge_broadcasts_no_table_that_grows(spark, monkeypatch):
    """Probes for close words were gathered in the driver, as Spark expects far too few rows behind explode."""
    rows = [("GS1", MISSPELT, 2), ("GS1", MISSPELT.replace("northern", "nothern"), 1)]
    joins = _joins_of(monkeypatch, lambda: D.near_merged(spark.createDataFrame(rows, "paper string, norm string, n_refs long"), spark.createDataFrame([(p, n, "u") for p, n, _ in rows[:1]], "paper string, norm string, base string")))
    assert len(joins) > 10 and not [x for x in joins if "Broadcast" in x]


def test_a_misspelt_common_word_brings_few_candidates(spark):
    """A text whose rarest word is a misspelt common one asks for its other rare words; its near duplicate is found all the same."""
    rng = random.Random(3)
    frame = "administrative review policy impact across districts where farmers joined after reform".split()
    rare = lambda: ["".join(rng.choice("bdghklmnprstvz") + rng.choice("aeiou") for _ in range(5)) for _ in range(4)]
    same = rare()
    rows = [" ".join(frame + w) for w in (*(rare() for _ in range(100)), same)]
    odd = rows[-1].replace("administrative", "administrattive")
    got = [(r["a"], r["b"]) for r in D.near_candidates(spark.createDataFrame([("GS1", x) for x in [*rows, odd]], "paper string, norm string")).collect()]
    assert (min(odd, rows[-1]), max(odd, rows[-1])) in got
    assert sum(odd in p for p in got) < 10


def test_word_candidates_shuffle_no_blocks(spark):
    """Blocks that meet are read again, as their shuffle grew as the square of a paper's texts."""
    df = spark.createDataFrame([("GS1", MISSPELT), ("GS1", f"{MISSPELT} again")], "paper string, norm string")
    plan = D.word_candidates(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_everything_merged_broadcasts_no_table_that_grows(spark, monkeypatch):
    rows = [(1, MISSPELT, "", "", "GS1", "u1", "question", 2019), (2, MISSPELT.replace("northern", "nothern"), "", "", "GS1", "u2", "question", 2020)]
    df = spark.createDataFrame(rows, "ord long, question string, marks string, words string, paper string, base string, kind string, year int")
    joins = _joins_of(monkeypatch, lambda: D.all_merged(df))
    assert len(joins) > 10 and not [x for x in joins if "Broadcast" in x]


def test_refs_conserved_near_broadcasts_no_table_that_grows(spark, monkeypatch):
    from conftest import DATA

    from pustaka.plans import dedupe as P

    joins = _joins_of(monkeypatch, lambda: P.refs_conserved_near(spark, DATA))
    assert len(joins) > 10 and not [x for x in joins if "Broadcast" in x]
