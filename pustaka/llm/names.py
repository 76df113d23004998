"""Variant spellings of one person's name.

A prefix-filtered set-similarity join on token q-grams, verified by a soft token similarity in which rare tokens count
more. A name is a list of tokens without titles, ranks and captions. The q-grams of a token are its padded three-letter
windows, each as a set of letters, so that two letters changing places break few of them. Tokens whose q-gram sets are
similar enough are joined on pairs of q-grams out of the prefixes of their sets, rarest first; a token so joined to a
spelling that is no less frequent may be one of its variants, at whatever count. Names that share the rare token, under any of its spellings, and the
initial of another are candidates; they are verified token by token.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pustaka.session import cut

#: Titles before a name. Fixed values.
TITLES = ("adv", "dr", "er", "kumari", "km", "miss", "mr", "mrs", "ms", "prof", "shri", "smt", "sri", "capt", "col", "maj")
#: Captions after a name. Fixed values.
CAPTIONS = r"(?i)(?:\s|_)*(?:[(\[]?\s*(?:rank|air)\s*[-#:]?\s*\d+\s*[)\]]?|upsc\s+topper|topper|copy|ias|ips)\s*$"
#: Names that mean nobody, in lower case. Fixed values.
NOBODY = ("", "unknown", "n/a", "na", "nil", "none", "-")
#: The least similarity of the q-gram sets of two spellings of a token, and of two names.
TOKEN_SIM, NAME_SIM = 0.33, 0.62
#: The least similarity of two spellings of one token.
SPELT = 0.92
#: Tokens of more q-grams than this are joined on single q-grams.
LONG_TOKEN = 48
#: Tokens of at most so many letters are compared by what is left when one letter is taken out, as one edit breaks most of their q-grams.
SHORT_TOKEN = 6
#: A token of at least this share of the weight of a name's rarest one is in the prefix.
PREFIX = 0.6
#: Names of one key are compared in blocks of about so many, each pair of blocks apart.
KEY_BLOCK = 500
#: Rounds after which following the hubs gives up; each one halves the way that is left.
MOST_ROUNDS = 60


def _whole(df: DataFrame) -> DataFrame:
    """A table that grows with the names, for a join that must broadcast neither side: of what comes out of explode or mapInArrow Spark expects
    a small part, and would send all of it through the driver."""
    return df.hint("merge")


def name_tokens(c: Column) -> Column:
    """The lower-case tokens of a name: words split at spaces, marks and changes of case, without titles and captions."""
    x = F.regexp_replace(F.regexp_replace(F.trim(c), CAPTIONS, ""), CAPTIONS, "")
    x = F.regexp_replace(x, r"(\p{Ll})(\p{Lu})", "$1 $2")
    parts = F.filter(F.split(F.lower(x), r"[^\p{L}\p{M}\p{N}]+"), lambda t: (t != "") & ~t.isin(*TITLES) & ~t.rlike(r"^\d+$"))
    return F.array_sort(parts)


def sound(t: Column) -> Column:
    """A token with what is spelled either way written one way: oo and u, ee and i, w and v, doubled letters and single ones."""
    return F.regexp_replace(F.replace(F.replace(F.replace(t, F.lit("oo"), F.lit("u")), F.lit("ee"), F.lit("i")), F.lit("w"), F.lit("v")), r"(\p{L})\1+", "$1")


def grams(token: str) -> list[str]:
    """The letter sets of the padded three-letter windows of a token; repeats are numbered."""
    t = f"\x01{token}\x02"
    seen: dict[str, int] = {}
    out = []
    for i in range(max(len(t) - 2, 1)):
        g = "".join(sorted(t[i : i + 3]))
        seen[g] = seen.get(g, 0) + 1
        out.append(g if seen[g] == 1 else f"{g}{seen[g]}")
    return out


def _least_common(m: int, n: int, sim: float) -> int:
    return math.ceil(sim * (m + n) / (1 + sim) - 1e-9)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column(0).to_pylist()
        sets = [grams(t) for t in tokens]
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(sets, pa.list_(pa.string()))], names=["token", "grams"])


def _prefix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each token, whose q-grams come rarest first, and each size its partner may have: the pairs of q-grams of its prefix.

    Sets of sizes m and n that are similar enough share at least k q-grams; so within their first m - k + 2 and
    n - k + 2 they share two.
    """
    for b in batches:
        key: list[str] = []
        token: list[str] = []
        for t, gs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            m = len(gs)
            for n in range(max(2, m - 1), m + 2):
                k = max(_least_common(m, n, TOKEN_SIM), 2)
                if k > min(m, n):
                    continue
                size = f"{min(m, n)},{max(m, n)}"
                if min(m, n) > LONG_TOKEN:  # single q-grams, as pairs would be too many
                    p = gs[: m - k + 1]
                    key += [f"{size}|{x}" for x in p]
                    token += [t] * len(p)
                    continue
                p = gs[: m - k + 2]
                for i in range(len(p)):
                    for j in range(i + 1, len(p)):
                        x, y = (p[i], p[j]) if p[i] < p[j] else (p[j], p[i])
                        key.append(f"{size}|{x}|{y}")
                        token.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(token, pa.string())], names=["key", "token"])


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """(ta, tb), ta < tb: the tokens of a column `token` that sound alike, or whose q-gram sets have a similarity of TOKEN_SIM
    or more and that are one edit apart (a letter put in, left out or changed, or two neighbours changing places)."""
    g = cut(tokens.select("token").distinct().mapInArrow(_gram_rows, "token string, grams array<string>"), "grams")
    df = g.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    ordered = (
        g.select("token", F.explode("grams").alias("gram"))
        .join(_whole(df), "gram")
        .groupBy("token")
        .agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("l"))
        .select("token", F.expr("transform(l, x -> x.gram)").alias("grams"))
    )
    keys = ordered.mapInArrow(_prefix_keys, "key string, token string").select(F.xxhash64("key").alias("key"), "token")
    a, b = keys.select("key", F.col("token").alias("ta")), keys.select("key", F.col("token").alias("tb"))
    near = (F.levenshtein("ta", "tb", 2) >= 0) & (F.abs(F.length("ta") - F.length("tb")) <= 1)
    pairs = a.join(_whole(b), "key").filter("ta < tb").filter(near).select("ta", "tb").distinct()
    short = tokens.select("token").distinct().filter(F.length("token") <= SHORT_TOKEN)
    left = short.select("token", F.explode(F.array_distinct(F.concat(F.array("token"), F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.overlay(F.col("token"), F.lit(""), i, F.lit(1)))))).alias("key"))
    pairs = pairs.union(left.withColumnRenamed("token", "ta").join(_whole(left.withColumnRenamed("token", "tb")), "key").filter("ta < tb").select("ta", "tb"))
    heard = tokens.select("token").distinct().filter(F.length("token") > 3).withColumn("key", sound(F.col("token")))
    alike = heard.withColumnRenamed("token", "ta").join(_whole(heard.withColumnRenamed("token", "tb")), "key").filter("ta < tb").select("ta", "tb")
    return pairs.mapInArrow(_one_edit, "ta string, tb string").union(alike).distinct()


def _one_edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([_edit1(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.bool_()))


def _edit1(a: str, b: str) -> bool:
    """At most one edit apart, two neighbouring letters changing places being one."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _sound(t: str) -> str:
    return re.sub(r"(.)\1+", r"\1", t.replace("oo", "u").replace("ee", "i").replace("w", "v"))


def token_sim(a: str, b: str) -> float:
    """How far two tokens may be one: equal, an initial, a nickname or short form, a misspelling."""
    if a == b:
        return 1.0
    if len(a) > 3 and len(b) > 3 and _sound(a) == _sound(b):
        return 0.95
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if len(s) == 1:
        return 0.9 if t[0] == s else 0.0
    if len(s) >= 4 and _edit1(a, b):
        return 0.92
    if len(s) >= 3 and s[0] == t[0] and len(t) > len(s):
        same = 0
        while same < len(s) and s[same] == t[same]:
            same += 1
        if same == len(s) or (same >= 3 and len(s) - same <= 1):
            return 0.85
        if same >= 2 and len(s) <= 6 and s[-1] in "aiuoy":
            return 0.7
    return 0.0


def name_sim(a: list[str], b: list[str], wa: list[float], wb: list[float]) -> float:
    """The share of the weight of two names that finds its partner in the other, tokens paired best first.

    Tokens left over on both sides mean two persons; what is left over on one side is a part that the other leaves out. Initials and
    short forms alone name nobody: of a name all of whose tokens are paired, one of the rare ones is in the other, as it is or misspelt.
    """
    pairs = sorted(((token_sim(x, y), min(wa[i], wb[j]), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    ua, ub, got = set(), set(), 0.0
    rare_a, rare_b = (PREFIX * max((w for t, w in zip(x, wx, strict=True) if len(t) > 1), default=math.inf) for x, wx in ((a, wa), (b, wb)))
    held_a = held_b = False
    for s, _, i, j in pairs:
        if s > 0 and i not in ua and j not in ub:
            ua.add(i)
            ub.add(j)
            if s >= SPELT and len(a[i]) > 1 and len(b[j]) > 1:
                held_a, held_b = held_a or wa[i] >= rare_a, held_b or wb[j] >= rare_b
            got += s * (min(wa[i], wb[j]) if len(a[i]) == 1 or len(b[j]) == 1 else max(wa[i], wb[j]))
    left = [wa[i] for i in range(len(a)) if i not in ua]
    right = [wb[j] for j in range(len(b)) if j not in ub]
    whole = got + 0.5 * sum(left + right)
    held = (held_a and not left) or (held_b and not right)
    return got / whole if whole and held else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = lambda c: b.column(b.schema.get_field_index(c))
        ta, tb, wa, wb = (col(c).to_pylist() for c in ("ta", "tb", "wa", "wb"))
        sim = [name_sim(*x) for x in zip(ta, tb, wa, wb, strict=True)]
        yield pa.RecordBatch.from_arrays([col("ca"), col("cb"), pa.array(sim, pa.float64())], names=["ca", "cb", "sim"])


def classes(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The different names (name, cid, n), and the classes of names of the same tokens (cid, tokens, n)."""
    names = df.select(F.col(name).alias("name")).filter(F.col("name").isNotNull() & ~F.lower(F.trim("name")).isin(*NOBODY)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    names = cut(names.select("name", "n", name_tokens(F.col("name")).alias("tokens")).filter(F.size("tokens") > 0).withColumn("cid", F.xxhash64("tokens")), "names")
    return names.select("name", "cid", "n"), names.groupBy("cid").agg(F.first("tokens").alias("tokens"), F.sum("n").alias("n"))


def _pairs_of_keys(keyed: DataFrame, block: int = KEY_BLOCK) -> DataFrame:
    """(ca, cb), ca < cb: the classes that share a key. A key of many classes is dealt into blocks, and each two blocks meet in a
    row group of their own, so that no task holds all of a common surname."""
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > block).select("key", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    k = keyed.join(many, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    meets = k.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "cid", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    a, b = meets.withColumnsRenamed({"cid": "ca", "own": "oa"}), meets.withColumnsRenamed({"cid": "cb", "own": "ob"})
    # within a block all pairs, across two blocks those of one from each
    return a.join(_whole(b), ["key", "x", "y"]).filter((F.col("ca") < F.col("cb")) & ((F.col("x") == F.col("y")) | (F.col("oa") != F.col("ob")))).select("ca", "cb").distinct()


def _asked_pairs(asks: DataFrame, holds: DataFrame, block: int = KEY_BLOCK) -> DataFrame:
    """(ca, cb), ca < cb: the classes of which one asks for a key that the other holds. Those that hold a common key are dealt into blocks."""
    many = holds.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > block).select("key", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    dealt = lambda k: k.join(many, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = dealt(asks).select("key", F.col("cid").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
    y = dealt(holds).select("key", F.col("cid").alias("y"), F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("at"))
    return x.join(_whole(y), ["key", "at"]).filter("x <> y").select(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).distinct()


def links(cls: DataFrame) -> DataFrame:
    """(ca, cb, sim), ca < cb: the classes of names of a soft similarity of NAME_SIM or more.

    Of two such names one has all its tokens paired, a rare one with a spelling of it. So it asks for each spelling of its rare tokens, with the
    first letter of a spelling of another token, and every name holds all its tokens with the first letters of the others.
    """
    tok = cls.select("cid", F.posexplode("tokens").alias("pos", "token"))
    df = cut(tok.filter(F.length("token") > 1).groupBy("token").agg(F.count_distinct("cid").alias("c")), "tokens")
    sim = cut(similar_tokens(df.select("token")), "similar")
    both = sim.select(F.col("ta").alias("token"), F.col("tb").alias("as")).union(sim.select(F.col("tb").alias("token"), F.col("ta").alias("as")))
    scored = both.join(_whole(df.select(F.col("token").alias("as"), F.col("c").alias("ac"))), "as")
    known = df.join(_whole(scored.groupBy("token").agg(F.max("ac").alias("most"), F.collect_list("as").alias("spellings"))), "token", "left")
    # a token weighs as much as its most frequent spelling
    known = known.select("token", F.greatest("c", F.coalesce("most", F.lit(0))).alias("c"), F.concat(F.array("token"), F.coalesce("spellings", F.array().cast("array<string>"))).alias("spellings"))
    total = cls.count()
    weighted = (
        tok.join(_whole(known), "token", "left")
        .withColumn("w", F.when(F.length("token") > 1, F.log(F.lit(float(total + 1)) / F.coalesce("c", F.lit(1)))).otherwise(F.lit(1.0)))
        .withColumn("letters", F.array_distinct(F.transform(F.coalesce("spellings", F.array("token")), lambda x: x.substr(1, 1))))
        .groupBy("cid")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "token", "w", "spellings", "letters"))).alias("l"))
    )
    own = cut(weighted.select("cid", F.expr("transform(l, x -> x.token)").alias("t"), F.expr("transform(l, x -> x.w)").alias("w"), "l"), "weighted")
    full = lambda x: F.length(x["token"]) > 1
    top = F.array_max(F.transform(F.filter("l", full), lambda x: x["w"]))
    first = lambda letters: F.explode(F.when(F.size("l") > 1, F.array_distinct(letters)).otherwise(F.array(F.lit(""))))
    asks = own.withColumn("top", top).select("cid", "l", F.explode(F.filter("l", lambda x: full(x) & (x["w"] >= PREFIX * F.col("top")))).alias("p"))
    # any one of the others is paired too
    one = F.element_at(F.filter("l", lambda x: x["pos"] != F.col("p.pos")), 1)["letters"]
    asks = asks.withColumn("letter", first(one)).withColumn("spelling", F.explode("p.spellings")).select(F.xxhash64("spelling", "letter").alias("key"), "cid").distinct()
    holds = own.select("cid", "l", F.explode(F.filter("l", full)).alias("p"))
    rest = F.array_distinct(F.concat(F.transform(F.filter("l", lambda x: x["pos"] != F.col("p.pos")), lambda x: x["token"].substr(1, 1)), F.array(F.lit(""))))
    holds = holds.withColumn("letter", F.explode(rest)).select(F.xxhash64("p.token", "letter").alias("key"), "cid").distinct()
    cand = _asked_pairs(asks, holds)
    a, b = (own.select(F.col("cid").alias(f"c{x}"), F.col("t").alias(f"t{x}"), F.col("w").alias(f"w{x}")) for x in "ab")
    pairs = cand.join(_whole(a), "ca").join(_whole(b), "cb")
    return pairs.mapInArrow(_verify, "ca long, cb long, sim double").filter(F.col("sim") >= NAME_SIM)


def followed(hub: DataFrame) -> DataFrame:
    """(x, hub): the end of the way that starts at each x and goes from hub to hub. A hub that is its own ends it; there is no circle."""
    for _ in range(MOST_ROUNDS):
        up = cut(hub.join(_whole(hub.select(F.col("x").alias("hub"), F.col("hub").alias("up"))), "hub"), "hubs")
        hub = up.select("x", F.col("up").alias("hub"))
        if up.filter("up <> hub").limit(1).count() == 0:
            return hub
    raise RuntimeError("chains of names did not end")


def persons(df: DataFrame, name: str = "topper") -> DataFrame:
    """(name, person, n): every different name with the person it means, named by the spelling of most rows.

    A class of names goes to the fullest and most frequent name it is linked to, and so to the person of that one. Null,
    blank and placeholder names mean nobody; repeated rows count; names are compared as stored; an empty table gives an
    empty result; only the named column is read.
    """
    names, cls = classes(df, name)
    found = cut(links(cls), "links")
    size = cls.select("cid", F.struct(F.when(F.exists("tokens", lambda t: F.length(t) == 1) | (F.size("tokens") < 2), F.lit(0)).otherwise(F.lit(1)).alias("full"), "n", "cid").alias("rank"))
    both = found.select(F.col("ca").alias("x"), F.col("cb").alias("cid")).union(found.select(F.col("cb").alias("x"), F.col("ca").alias("cid"))).union(cls.select(F.col("cid").alias("x"), "cid"))
    hub = cut(both.join(_whole(size), "cid").groupBy("x").agg(F.max_by("cid", "rank").alias("hub")), "hubs")
    hub = followed(hub)
    placed = names.join(_whole(hub.withColumnRenamed("x", "cid")), "cid")
    title = placed.groupBy("hub").agg(F.max_by("name", F.struct((F.col("cid") == F.col("hub")).alias("own"), "n", "name")).alias("person"))
    return placed.join(_whole(title), "hub").select("name", "person", "n")


def name_pairs(df: DataFrame, name: str = "topper") -> DataFrame:
    """(a, b), a < b by code points: two different names, as stored, that mean one person."""
    p = cut(persons(df, name), "persons").select("name", "person")
    return p.withColumnRenamed("name", "a").join(_whole(p.withColumnRenamed("name", "b")), "person").filter("a < b").select("a", "b")
