"""Near-duplicate texts by an LSH forest over their sets of words.

A text is the set of its distinct words. Each text has several signatures: its words in several orders. The signatures of
an order are sorted, and the candidates of a text are its neighbours of the longest common prefix. How long that prefix
must be is set by region, from the data: a stretch of the order that shares a prefix and is small is deep enough; a larger
one is cut where the next word changes, and so on. A large stretch whose neighbours are alike holds many copies with small
edits, which a deeper cut would only part, so it is compared as a whole, in blocks that are spread over the tasks.

Where a signature starts with a rare word, one word is depth enough, as the stretch is small by the word's own count; so
each rare word of a text leads one of its signatures. The others are random orders of its frequent words that favour the
less frequent ones. Orders are placed on the tasks by a hash of their first words, as many as make a stretch small by the
counts of these words; within a place they are sorted, and the data decide.

Two facts make the search sharp and lose nothing. Sets of sizes m and n with a similarity of at least 0.8 differ in at
most (m + n) / 9 words, so a 64-bit parity sketch of each set rejects most candidates. And if two such sets share no
rare word, all rare words of either are among those that differ; so one of them has at most a ninth of its words rare,
and only places in which such a plain text lies need the random orders at all.

Word counts are kept in a count-min sketch whose size is a parameter; it covers all texts, and its errors can only make
a word look more frequent, which costs time and never a result. Candidates are verified exactly.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pustaka.operators.components import components
from pustaka.session import cut

#: log2 of the cells of the sketch of word counts, and of the bits that mark the regions of plain texts.
SKETCH_BITS, MARK_BITS = 22, 24
#: A word in at most so many texts is rare.
RARE = 64
#: Random signature orders, the expected size of a place, and the greatest number of words that make one.
TREES, REGION, DEPTH = 16, 64.0, 24
#: Words of an order that are sorted within a place, the size at which a stretch needs no more depth, and the share of neighbours
#: that are alike in a stretch that is compared as a whole.
TAIL, SMALL, ALIKE = 8, 128, 0.5
#: A stretch compared as a whole that has more sets is cut into blocks of so many; and the most rows of a place that a task holds.
BLOCK, HELD = 1024, 1 << 18
_BLOCKS = 16


def words(text: Column) -> Column:
    """The distinct runs of letters and digits of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1))


def word_sets(df: DataFrame, row_id: str, text: str, least: int = 10) -> DataFrame:
    """(id, h, toks): the hashed word set of each text of at least `least` distinct words, and the set's own hash."""
    w = df.select(F.col(row_id).cast("long").alias("id"), words(F.col(text)).alias("w")).filter(F.size("w") >= least)
    toks = F.array_sort(F.transform("w", lambda x: F.xxhash64(x).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))
    return w.select("id", toks.alias("toks")).select("id", F.xxhash64("toks").alias("h"), "toks")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _lists(batch: pa.RecordBatch, seen: set) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, length and flat words of the sets of a batch that this task has not met before."""
    col = lambda c: batch.column(batch.schema.get_field_index(c))
    h = col("h").to_numpy(zero_copy_only=False)
    fresh = [i for i, x in enumerate(h.tolist()) if x not in seen and not seen.add(x)]
    toks = col("toks").take(pa.array(fresh, pa.int32())) if len(fresh) < len(h) else col("toks")
    return h[fresh], np.diff(toks.offsets.to_numpy()), toks.flatten().to_numpy(zero_copy_only=False)


def _pack(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, a=a)
    return out.getvalue()


def _unpack(b: bytes) -> np.ndarray:
    return np.load(io.BytesIO(b))["a"]


def _collect_blocks(df: DataFrame, op) -> np.ndarray:
    """Sums or ors the (block, data) rows of df by block, as a stream, and gathers the blocks: a fixed size in all."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = _unpack(d)
                held[k] = op(held[k], a) if k in held else a
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([_pack(a) for a in held.values()], pa.binary())], names=["block", "data"])

    got = df.repartition(_BLOCKS, "block").mapInArrow(merge, "block int, data binary").collect()
    return np.concatenate([_unpack(r["data"]) for r in sorted(got, key=lambda r: r["block"])]) if got else np.zeros(0, np.uint32)


def count_sketch(sets: DataFrame, bits: int = SKETCH_BITS) -> tuple[np.ndarray, int]:
    """How many sets hold the words of each cell, and about how many sets there are (copies count once a task)."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        cells = np.zeros(1 << bits, np.uint32)
        for b in batches:
            h, _, flat = _lists(b, seen)
            cells += np.bincount(flat & ((1 << bits) - 1), minlength=1 << bits).astype(np.uint32)
        if seen:
            parts = np.split(cells, _BLOCKS)
            parts = [*parts, np.array([len(seen)], np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BLOCKS + 1), pa.int32()), pa.array([_pack(p) for p in parts], pa.binary())], names=["block", "data"])

    flat = _collect_blocks(sets.select("h", "toks").mapInArrow(worker, "block int, data binary"), lambda a, b: a + b)
    return (flat[:-1].astype(np.uint32), int(flat[-1])) if len(flat) else (np.zeros(1 << bits, np.uint32), 0)


def _signatures(flat: np.ndarray, df: np.ndarray, n: np.ndarray, total: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """In each tree the place of each set, a hash of the first frequent words of the order that make a place small by their counts, and the next words."""
    out = np.zeros((len(n), trees), np.uint64)
    tail = np.zeros((len(n), trees, TAIL), ">u4")
    if not len(n):
        return out, tail
    width = int(n.max())
    at = np.arange(width)[None, :] < n[:, None]
    tok = np.zeros((len(n), width), np.uint64)
    rate = np.ones((len(n), width))
    tok[at] = flat
    rate[at] = np.minimum(df / max(total, 1), 0.999)
    use = at & (rate * total > RARE)
    weight = -np.log(rate, where=use, out=np.full(rate.shape, 1e-12))
    rows = np.arange(len(n))
    for t in range(trees):
        u = (_mix(tok + np.uint64((t + 1) << 40)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        order = np.where(use, -np.log(u + 1e-18) / weight, np.inf)
        deep = min(DEPTH + TAIL, width)
        first = np.argpartition(order, deep - 1, axis=1)[:, :deep] if deep < width else np.broadcast_to(np.arange(width), order.shape)
        rank = np.argsort(np.take_along_axis(order, first, 1), axis=1)
        first = np.take_along_axis(first, rank, 1)
        ok = np.take_along_axis(use, first, 1)
        word = np.take_along_axis(tok, first, 1)
        size = np.log(max(total, 1)) + np.cumsum(np.where(ok, np.log(np.take_along_axis(rate, first, 1)), 0), axis=1)
        needed = ok & (np.concatenate([np.full((len(n), 1), np.inf), size[:, :-1]], 1) > np.log(REGION)) & (np.arange(deep) < DEPTH)[None, :]
        key = np.full(len(n), (t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for d in range(min(DEPTH, deep)):
            key = np.where(needed[:, d], _mix(key * np.uint64(31) + word[:, d] + np.uint64(1)), key)
        out[:, t] = key
        start = needed.sum(1)
        for d in range(TAIL):
            at_d = np.minimum(start + d, deep - 1)
            tail[:, t, d] = np.where((start + d < deep) & ok[rows, at_d], word[rows, at_d], 0)
    return out, tail


def _by_length(n: np.ndarray, cells: int = 1 << 18) -> Iterator[np.ndarray]:
    """Row numbers in groups of like length, so that a padded table stays small; a very long text stands alone."""
    order = np.argsort(n, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * int(n[order[stop]]) <= cells:
            stop += 1
        yield order[start:stop]
        start = stop


def _rows_of(flat: np.ndarray, n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The places in flat of the words of some rows."""
    off = np.concatenate([[0], np.cumsum(n)])
    k = n[rows]
    return np.repeat(off[rows] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())


def _plain_marks(sets: DataFrame, sketch, total: int, trees: int) -> np.ndarray:
    """Bits that mark the regions in which a plain text lies."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, bits, any_plain = sketch.value, set(), np.zeros(1 << (MARK_BITS - 3), np.uint8), False
        mask = len(counts) - 1
        for b in batches:
            h, n, flat = _lists(b, seen)
            if not len(n):
                continue
            df = counts[flat & mask]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            rare = np.add.reduceat((df <= RARE).astype(np.int64), starts)
            plain = np.flatnonzero(9 * rare <= n)
            for rows in _by_length(n[plain]):
                rows = plain[rows]
                at = _rows_of(flat, n, rows)
                key = _signatures(flat[at], df[at], n[rows], total, trees)[0].ravel() & np.uint64((1 << MARK_BITS) - 1)
                np.bitwise_or.at(bits, (key >> np.uint64(3)).astype(np.int64), np.left_shift(1, key & np.uint64(7)).astype(np.uint8))
                any_plain = True
        if any_plain:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BLOCKS), pa.int32()), pa.array([_pack(p) for p in np.split(bits, _BLOCKS)], pa.binary())], names=["block", "data"])

    return _collect_blocks(sets.select("h", "toks").mapInArrow(worker, "block int, data binary"), np.bitwise_or)


def _entries(sets: DataFrame, sketch, marks, total: int, trees: int) -> DataFrame:
    """(region, tail, h, parity, n, rare): a row for each place a set lies in, with the words of the order that follow; copies give one row a task."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, bits = sketch.value, set(), marks.value
        mask = len(counts) - 1
        for b in batches:
            h, n, flat = _lists(b, seen)
            if not len(n):
                continue
            df = counts[flat & mask]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            rare = np.add.reduceat((df <= RARE).astype(np.int64), starts)
            mixed = _mix(flat)
            parity = np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), mixed >> np.uint64(58)), starts)
            lead = np.flatnonzero((df >= 2) & (df <= RARE))
            row, key, tails = [np.repeat(np.arange(len(n)), n)[lead]], [mixed[lead]], [pa.array([b""] * len(lead), pa.binary())]
            if len(bits):
                near = np.flatnonzero(4 * rare <= n)
                for rows in _by_length(n[near]):
                    rows = near[rows]
                    at = _rows_of(flat, n, rows)
                    sig, tail = _signatures(flat[at], df[at], n[rows], total, trees)
                    low = sig & np.uint64((1 << MARK_BITS) - 1)
                    hit = (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1
                    r, t = np.nonzero(hit)
                    row.append(rows[r])
                    key.append(sig[r, t])
                    tails.append(pa.array(np.ascontiguousarray(tail[r, t]).view(f"V{4 * TAIL}").ravel().tolist(), pa.binary()))
            row, key = np.concatenate(row), np.concatenate(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.concat_arrays(tails), pa.array(h[row]), pa.array(parity[row].view(np.int64)), pa.array(n[row].astype(np.int32)), pa.array(rare[row].astype(np.int32))],
                names=["region", "tail", "h", "parity", "n", "rare"],
            )

    return sets.select("h", "toks").mapInArrow(worker, "region long, tail binary, h long, parity long, n int, rare int")


def _near(a: np.ndarray, b: np.ndarray, parity: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets may have a similarity of 0.8: by size and by the parity of what differs."""
    s = n[a] + n[b]
    return (9 * np.bitwise_count(parity[a] ^ parity[b]).astype(np.int64) <= s) & (9 * np.minimum(n[a], n[b]) >= 4 * s)


def _stretch_pairs(a: np.ndarray, b: np.ndarray, h: np.ndarray, p: np.ndarray, n: np.ndarray, r: np.ndarray, led: bool) -> np.ndarray:
    """The pairs of hashes, one of rows a and one of rows b (which may be the same), that may be similar. Sets of a random order must share no
    rare word, as those that do meet where it leads."""
    out = []
    step = max(1, (1 << 20) // max(len(b), 1))
    for k in range(0, len(a), step):
        x, y = a[k : k + step, None], b[None, :]
        s = n[x] + n[y]
        ok = (9 * np.bitwise_count(p[x] ^ p[y]).astype(np.int64) <= s) & (9 * np.minimum(n[x], n[y]) >= 4 * s)
        if not led:
            ok &= 9 * (r[x] + r[y]) <= s
        i, j = np.nonzero(ok)
        u, v = h[a[k + i]], h[b[j]]
        one = u < v if a is b else u != v
        out.append(np.stack([np.minimum(u, v)[one], np.maximum(u, v)[one]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


_FOUND = "ha long, hb long, stretch long, block int, parity long, n int, rare int"


def _found(pairs: list[np.ndarray], big: list[tuple]) -> pa.RecordBatch:
    """Pairs, and the sets of the stretches that are too large to be compared here, as one batch."""
    two = np.concatenate([*pairs, np.zeros((0, 2), np.int64)])
    blank, m = np.zeros(len(two), bool), len(two)
    stretch, block, h, p, n, r = (np.concatenate([x[i] for x in big]) if big else np.zeros(0, np.int64) for i in range(6))
    none = np.concatenate([~blank, np.zeros(len(h), bool)])  # pairs have no stretch
    col = lambda head, rest, t, mask=None: pa.array(np.concatenate([head, rest]).astype(t), mask=mask)
    zero = np.zeros(m, np.int64)
    return pa.RecordBatch.from_arrays(
        [col(two[:, 0], h, np.int64), col(two[:, 1], h, np.int64), col(zero, stretch, np.int64, none), col(zero, block, np.int32), col(zero, p, np.int64), col(zero, n, np.int32), col(zero, r, np.int32)],
        names=[c.split()[0] for c in _FOUND.split(", ")],
    )


def _common_prefix(tail: np.ndarray) -> np.ndarray:
    """How many words each row of a sorted table has in common with the next one."""
    same = tail[1:] == tail[:-1]
    return np.where(same.all(1), tail.shape[1], np.argmin(same, axis=1)) if len(same) else np.zeros(0, np.int64)


def _neighbours(k: np.ndarray, tail: np.ndarray, h: np.ndarray, p: np.ndarray, n: np.ndarray, r: np.ndarray) -> pa.RecordBatch | None:
    """Neighbours of the longest common prefix in whole places of a sorted order."""
    keep = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])  # copies of a set that came from several tasks
    k, tail, h, p, n, r = (x[keep] for x in (k, tail, h, p, n, r))
    lcp = _common_prefix(tail)
    ends = np.concatenate([np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
    starts = np.concatenate([[0], ends[:-1]])
    led = ~tail.any(1)
    pairs: list[np.ndarray] = []
    big: list[tuple] = []
    size = ends - starts
    # the many small places, all at once: each row with the next one, the one after it, and so on
    small = np.repeat(size <= SMALL, size)
    for step in range(1, min(int(size.max()), SMALL)):
        a = np.flatnonzero(small[:-step] & (k[step:] == k[:-step]))
        if not len(a):
            break
        a = a[_near(a, a + step, p, n)]
        u, v = h[a], h[a + step]
        pairs.append(np.stack([np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]], 1))
    todo = [(s, e, 0) for s, e in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist(), strict=True)]
    while todo:
        s, e, depth = todo.pop()
        rows = np.arange(s, e)
        if e - s > SMALL and depth < TAIL and not led[s] and _near(rows[:-1], rows[1:], p, n).mean() < ALIKE:
            cuts = [s, *(np.flatnonzero(lcp[s : e - 1] <= depth) + s + 1).tolist(), e]
            todo += [(x, y, depth + 1) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x > 1]
        elif e - s <= 2 * BLOCK:
            pairs.append(_stretch_pairs(rows, rows, h, p, n, r, bool(led[s])))
        else:
            name = np.full(e - s, int(_mix(np.array([k[s] ^ np.uint64(int(h[s]) & 0xFFFFFFFFFFFFFFFF)], np.uint64)).view(np.int64)[0]))
            big.append((name, (rows - s) // BLOCK, h[rows], p[rows].view(np.int64), n[rows], r[rows]))
    return _found(pairs, big) if pairs or big else None


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the sorted orders of a partition and gives the neighbours, place by place."""

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        col = lambda c: b.column(b.schema.get_field_index(c))
        num = lambda c: col(c).to_numpy(zero_copy_only=False)
        tail = np.array([x or bytes(4 * TAIL) for x in col("tail").to_pylist()], f"S{4 * TAIL}") if b.num_rows else np.zeros(0, f"S{4 * TAIL}")
        words = np.frombuffer(tail.tobytes(), ">u4").reshape(b.num_rows, TAIL)
        return [num("region").view(np.uint64), words, num("h"), num("parity").view(np.uint64), num("n").astype(np.int64), num("rare").astype(np.int64)]

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns(batch)
        held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        end = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if held[0][0] != held[0][-1] else 0  # the last place may go on in the next batch
        if not end and len(held[0]) > HELD:
            # one place beyond what a task holds: it is cut where its neighbours have least in common
            half = len(held[0]) // 2
            end = half + int(np.argmin(_common_prefix(held[1][half:]))) + 1
        if end:
            if (out := _neighbours(*[c[:end] for c in held])) is not None:
                yield out
            held = [c[end:] for c in held]
    if held is not None and len(held[0]) and (out := _neighbours(*held)) is not None:
        yield out


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each two blocks of a stretch; a group of rows holds two blocks, or one with itself."""
    held: list[np.ndarray] | None = None
    names = ("stretch", "x", "y", "block", "h", "parity", "n", "rare")

    def pairs(stretch, x, y, block, h, p, n, r):
        p, n, r = p.view(np.uint64), n.astype(np.int64), r.astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero((stretch[1:] != stretch[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(h)]])
        out = []
        for s, e in zip(start[:-1], start[1:], strict=True):
            rows = np.arange(s, e)
            a, b = (rows, rows) if x[s] == y[s] else (rows[block[s:e] == x[s]], rows[block[s:e] == y[s]])
            out.append(_stretch_pairs(a, b, h, p, n, r, True))
        two = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], names=["ha", "hb"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        other = (held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1])
        if other.any():
            end = int(np.flatnonzero(other)[-1]) + 1
            yield pairs(*[c[:end] for c in held])
            held = [c[end:] for c in held]
    if held is not None:
        yield pairs(*held)


def candidates(sets: DataFrame, trees: int = TREES) -> DataFrame:
    """(ha, hb), ha < hb: the word sets that are neighbours in one of the orders and may be similar by size and parity."""
    spark = sets.sparkSession
    counts, total = count_sketch(sets)
    sketch = spark.sparkContext.broadcast(counts)
    marks = spark.sparkContext.broadcast(_plain_marks(sets, sketch, total, trees))
    entries = _entries(sets, sketch, marks, total, trees)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(entries.repartition(parts, "region").sortWithinPartitions("region", "tail", "h").mapInArrow(_forest, _FOUND), "neighbours")
    pairs = found.filter("stretch IS NULL").select("ha", "hb")
    big = found.filter("stretch IS NOT NULL").select("stretch", "block", F.col("ha").alias("h"), "parity", "n", "rare")
    if big.limit(1).count():
        blocks = big.groupBy("stretch").agg(F.max("block").alias("last"))
        two = big.join(blocks, "stretch").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
        at = ["stretch", "x", "y"]
        rest = two.select(*at, "block", "h", "parity", "n", "rare").repartition(parts, *at).sortWithinPartitions(*at).mapInArrow(_block_pairs, "ha long, hb long")
        pairs = pairs.union(rest)
    return pairs.distinct()


def similar_sets(sets: DataFrame, trees: int = TREES) -> DataFrame:
    """(ha, hb), ha < hb: the different word sets of a similarity of at least 0.8."""
    found = candidates(sets, trees)
    toks = sets.groupBy("h").agg(F.first("toks").alias("toks"))
    one = found.join(toks.select(F.col("h").alias("ha"), F.col("toks").alias("ta")), "ha")
    two = one.join(toks.select(F.col("h").alias("hb"), F.col("toks").alias("tb")), "hb")
    common = F.size(F.array_intersect("ta", "tb"))
    return two.filter(9 * common >= 4 * (F.size("ta") + F.size("tb"))).select("ha", "hb")


def similar_pairs(df: DataFrame, row_id: str = "submission_id", text: str = "question", least: int = 10) -> DataFrame:
    """(a, b), a < b: every two rows whose texts have a similarity of at least 0.8, equal texts included.

    Null, empty and short texts (fewer than `least` distinct words) take no part; very long ones are taken whole; an
    empty table gives an empty result; only the two named columns are read.
    """
    sets = cut(word_sets(df, row_id, text, least), "sets")
    links = cut(similar_sets(sets), "links")
    members = sets.select("h", "id")
    left = members.select(F.col("h").alias("ha"), F.col("id").alias("ia"))
    right = members.select(F.col("h").alias("hb"), F.col("id").alias("ib"))
    across = links.join(left, "ha").join(right, "hb").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    copies = left.join(right, F.col("ha") == F.col("hb")).filter("ia < ib").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    return across.union(copies)


def similar_groups(df: DataFrame, row_id: str = "submission_id", text: str = "question", least: int = 10) -> DataFrame:
    """(id, group_id, n_links): the group of every row that takes part, named by its least row, and to how many other
    word sets the row's own is linked. Copies are not expanded into pairs; a row like no other is its own group."""
    sets = cut(word_sets(df, row_id, text, least), "sets")
    links = cut(similar_sets(sets), "links")
    degree = links.select(F.explode(F.array("ha", "hb")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    group = components(links, "ha", "hb").select(F.col("node").alias("h"), "component")
    named = (
        sets.groupBy("h")
        .agg(F.min("id").alias("least"))
        .join(group, "h", "left")
        .join(degree, "h", "left")
        .withColumn("component", F.coalesce("component", "h"))
        .select("h", "least", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    names = named.groupBy("component").agg(F.min("least").alias("group_id"))
    return sets.select("id", "h").join(named.join(names, "component").select("h", "group_id", "n_links"), "h").select("id", "group_id", "n_links")
