"""Filling containers of a fixed capacity with whole documents.

A grouping genetic algorithm on islands. The documents are dealt into blocks of bounded size; each block is packed by
several islands, each with a population of packings. A packing is a list of bins. Crossover puts whole well-filled bins
of one parent into the other, drops the bins that hold a document twice, exchanges the documents so displaced with those
of the kept bins where that fills a bin better, and puts back what is left by best fit; mutation empties the worst bins and
does the same. Between rounds the best packing of each island moves to
the next island of its block. After the last round, bins that are still poorly filled are taken apart over all blocks
and their documents dealt into new blocks, while the well-filled ones stay.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pustaka.session import cut

#: Pieces in a block on average, islands of a block, rounds with migration between them, packings of an island, generations of a round.
BLOCK, ISLANDS, ROUNDS, POPULATION, GENERATIONS = 600, 2, 2, 4, 20
#: Generations without a better packing after which an island rests.
STALL = 5
#: Bins filled to less than this share are taken apart once.
POOR = 0.98
#: More capacities than this are refused, as each document is packed once for each.
MOST_PACKS = 100
SEED = 11

Packing = list[list[int]]


def best_fit(bins: Packing, loose: list[int], size: list[int], capacity: int) -> Packing:
    """Adds loose pieces, the largest first, each to the fullest bin that takes it."""
    room = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(loose, key=lambda i: -size[i]):
        at = bisect.bisect_left(room, (size[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        bisect.insort(room, (left - size[i], k))
    return bins


def fitness(bins: Packing, size: list[int], capacity: int) -> tuple[int, float]:
    """Few bins first, then bins that are either full or nearly empty."""
    return -len(bins), sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def exchange(bins: Packing, loose: list[int], size: list[int], capacity: int) -> list[int]:
    """Fills bins better by exchange with loose pieces, and gives the pieces that are loose then.

    One piece of a bin goes for a larger loose one, or for two; or two of its pieces for a larger one. Each exchange fills the bin
    more, so large pieces go into bins and the small ones, which fit anywhere, become loose.
    """
    pool = sorted((size[i], i) for i in loose)
    for b in bins:
        room = capacity - sum(size[i] for i in b)
        moved = True
        while room and pool and moved:
            moved = False
            best = (0, None, ())  # gain, places in the bin, places in the pool
            for x, p in enumerate(b):
                at = bisect.bisect_right(pool, (size[p] + room, 1 << 60)) - 1
                if at >= 0 and pool[at][0] - size[p] > best[0]:
                    best = (pool[at][0] - size[p], (x,), (at,))
                lo, hi = 0, len(pool) - 1
                while best[0] < room and lo < hi:  # two loose pieces of the largest sum that fits
                    two = pool[lo][0] + pool[hi][0] - size[p]
                    if two > room:
                        hi -= 1
                        continue
                    if two > best[0]:
                        best = (two, (x,), (lo, hi))
                    lo += 1
                if best[0] == room:
                    break
            if best[0] < room and len(b) <= 12:
                for x in range(len(b)):
                    for y in range(x):
                        s = size[b[x]] + size[b[y]]
                        at = bisect.bisect_right(pool, (s + room, 1 << 60)) - 1
                        if at >= 0 and pool[at][0] - s > best[0]:
                            best = (pool[at][0] - s, (x, y), (at,))
            if best[0]:
                gain, out, into = best
                fresh = [pool[k][1] for k in into]
                back = [b[k] for k in out]
                for k in sorted(into, reverse=True):
                    pool.pop(k)
                for k in sorted(out, reverse=True):
                    b.pop(k)
                b.extend(fresh)
                for i in back:
                    bisect.insort(pool, (size[i], i))
                room -= gain
                moved = True
    return [i for _, i in pool]


def crossover(a: Packing, b: Packing, size: list[int], capacity: int, rng: random.Random) -> Packing:
    """Injects some of the fullest bins of b into a."""
    fill = sorted(b, key=lambda x: -sum(size[i] for i in x))
    inject = [list(x) for x in fill[: max(1, len(fill) // 2)] if rng.random() < 0.6]
    held = {i for x in inject for i in x}
    keep, loose = [], []
    for x in a:
        if held.isdisjoint(x):
            keep.append(list(x))
        else:
            loose.extend(i for i in x if i not in held)
    bins = inject + keep
    return best_fit(bins, exchange(bins, loose, size, capacity), size, capacity)


def mutate(a: Packing, size: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empties some of the worst bins and one at random."""
    order = sorted(range(len(a)), key=lambda k: sum(size[i] for i in a[k]))
    out = set(order[: max(1, len(a) // 12)]) | {rng.randrange(len(a))}
    loose = [i for k in out for i in a[k]]
    bins = [list(x) for k, x in enumerate(a) if k not in out]
    rng.shuffle(bins)
    return best_fit(bins, exchange(bins, loose, size, capacity), size, capacity)


def _start(size: list[int], capacity: int, rng: random.Random) -> Packing:
    """Best fit of the pieces, the large ones by size and the small ones in any order."""
    noise = {i: s * rng.uniform(0.85, 1.0) for i, s in enumerate(size)}
    bins: Packing = []
    room: list[tuple[int, int]] = []
    for i in sorted(noise, key=lambda i: -noise[i]):
        at = bisect.bisect_left(room, (size[i], -1))
        left, k = room.pop(at) if at < len(room) else (capacity, len(bins))
        if k == len(bins):
            bins.append([])
        bins[k].append(i)
        bisect.insort(room, (left - size[i], k))
    return bins


def evolve(size: list[int], capacity: int, elites: list[Packing], seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """The best packing of an island after some generations. It ends when no packing can have fewer bins, or after STALL generations
    in which the best one stayed as it was."""
    rng = random.Random(seed)
    least = -(-sum(size) // capacity)
    pop = [[list(b) for b in e] for e in elites] or [best_fit([], list(range(len(size))), size, capacity)]
    if len(pop[0]) <= least:
        return pop[0]
    while len(pop) < population:
        pop.append(_start(size, capacity, rng))
    score = [fitness(p, size, capacity) for p in pop]
    best, still = max(score), 0
    for _ in range(generations):
        if best[0] >= -least or still == STALL:
            break
        order = sorted(range(len(pop)), key=lambda k: score[k], reverse=True)
        a, b = order[0], order[rng.randrange(1, len(order))]
        for child in (crossover(pop[a], pop[b], size, capacity, rng), mutate(pop[order[0]], size, capacity, rng)):
            f = fitness(child, size, capacity)
            worst = min(range(len(pop)), key=lambda k: score[k])
            if f > score[worst] and f not in score:
                pop[worst], score[worst] = child, f
        best, still = max(score), 0 if max(score) > best else still + 1
    return pop[max(range(len(pop)), key=lambda k: score[k])]


def _bins_of(labels: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


_STATE = "pack_name string, capacity long, block long, island int, docs array<long>, parts array<int>, sizes array<long>, elites array<array<int>>"


def _round(batches: Iterator[pa.RecordBatch], generations: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):  # one block at a time in Python's memory
            r = b.slice(k, 1).to_pylist()[0]
            packed = evolve(r["sizes"], r["capacity"], [_bins_of(e) for e in r["elites"] or []], hash((seed, r["capacity"], r["block"], r["island"])), generations)
            label = [0] * len(r["sizes"])
            for n, x in enumerate(packed):
                for i in x:
                    label[i] = n
            r["elites"] = [label]
            yield pa.RecordBatch.from_pylist([r], schema=b.schema)


def _evolved(pieces: DataFrame, blocks: int, islands: int, rounds: int, generations: int, seed: int) -> DataFrame:
    """(pack_name, capacity, block, bin, doc_id, part_no, n_tokens): the best packing that any island found for each block."""
    packed = pieces.groupBy("pack_name", "capacity", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "part_no", "n_tokens"))).alias("l"))
    base = packed.select("pack_name", "capacity", "block", F.expr("transform(l, x -> x.doc_id)").alias("docs"), F.expr("transform(l, x -> x.part_no)").alias("parts"), F.expr("transform(l, x -> x.n_tokens)").alias("sizes"))
    state = base.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.array().cast("array<array<int>>"))
    # a task for a few blocks, as a block is little work
    tasks = min(4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, blocks * islands // 4))
    order = ["pack_name", "capacity", "block", "island", "docs", "parts", "sizes", "elites"]
    for r in range(rounds):
        state = cut(state.select(*order).repartition(tasks, "pack_name", "block", "island").mapInArrow(lambda it, r=r: _round(it, generations, seed + r), _STATE), "islands")
        if r + 1 < rounds:  # the elite of each island joins the next one
            ring = state.select("pack_name", "block", ((F.col("island") + 1) % islands).alias("island"), F.col("elites").alias("guest"))
            state = state.join(ring, ["pack_name", "block", "island"]).withColumn("elites", F.array_distinct(F.concat("elites", "guest"))).drop("guest")
    quality = F.struct(-F.array_max(F.col("elites")[0]), -F.col("island"))
    best = state.groupBy("pack_name", "capacity", "block").agg(F.max_by(F.struct("docs", "parts", "sizes", F.col("elites")[0].alias("label")), quality).alias("b"))
    flat = best.select("pack_name", "capacity", "block", F.explode(F.arrays_zip("b.label", "b.docs", "b.parts", "b.sizes")).alias("x"))
    return flat.select("pack_name", "capacity", "block", F.col("x.label").alias("bin"), F.col("x.docs").alias("doc_id"), F.col("x.parts").alias("part_no"), F.col("x.sizes").alias("n_tokens"))


def _pieces(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity, doc_id, part_no, n_tokens): a document that fits is one piece, a larger one as many full pieces as it fills, and the rest."""
    few = packs.limit(MOST_PACKS + 1).collect()
    if len(few) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} capacities")
    each = [F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["capacity"]).cast("long").alias("capacity")) for r in few]
    both = sizes.withColumn("p", F.explode(F.array(*each) if each else F.expr("cast(array() as array<struct<pack_name:string,capacity:bigint>>)"))).select("*", "p.*")
    n, c = F.col("n_tokens"), F.col("capacity")
    count = F.greatest(F.ceil(n / c).cast("int"), F.lit(1))
    parts = both.withColumn("part_no", F.explode(F.sequence(F.lit(1), count))).withColumn("count", count)
    return parts.select("pack_name", "capacity", "doc_id", "part_no", F.when(F.col("part_no") < F.col("count"), c).otherwise(n - (F.col("count") - 1) * c).alias("n_tokens"))


def pack(sizes: DataFrame, packs: DataFrame, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS, seed: int = SEED) -> DataFrame:
    """(pack_name, container_id, doc_id, part_no, n_tokens): where each piece of each document lies, for each capacity.

    sizes: (doc_id, n_tokens); packs: (pack_name, capacity_tokens), a small table. A document without tokens, or of null
    size, takes a place and no room; a document larger than a container fills containers of its own, and its rest is
    packed with others; repeated doc_ids are kept apart by nothing but their pieces and stay whole. A null, zero or
    negative capacity packs nothing; empty tables give an empty result. No block holds more pieces than about twice
    `block`, whatever the keys, and no task sees all documents.
    """
    p = packs.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).filter("capacity > 0")
    s = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    total = s.count()
    blocks = max(1, round(total / block))
    pieces = _pieces(s, p)
    full = pieces.filter("n_tokens = capacity").select("pack_name", F.concat_ws("-", F.lit("f"), "doc_id", "part_no").alias("container_id"), "doc_id", "part_no", "n_tokens")
    dealt = pieces.filter("n_tokens < capacity").withColumn("block", F.pmod(F.xxhash64("doc_id", "part_no", F.lit(seed)), F.lit(blocks)))
    n_packs = max(1, p.count())
    first = cut(_evolved(dealt, blocks * n_packs, islands, rounds, generations, seed), "packed")
    by_bin = Window.partitionBy("pack_name", "block", "bin")
    filled = first.withColumn("fill", F.sum("n_tokens").over(by_bin) / F.col("capacity"))
    kept = filled.filter(F.col("fill") >= POOR).select("pack_name", F.concat_ws("-", F.lit("a"), "block", "bin").alias("container_id"), "doc_id", "part_no", "n_tokens")
    poor = cut(filled.filter(F.col("fill") < POOR).select("pack_name", "capacity", "doc_id", "part_no", "n_tokens"), "poor")
    again = max(1, round(poor.count() / n_packs / block))
    dealt = poor.withColumn("block", F.pmod(F.xxhash64("doc_id", "part_no", F.lit(seed + 1)), F.lit(again)))
    second = _evolved(dealt, again * n_packs, islands, rounds, generations, seed + 100)
    last = second.select("pack_name", F.concat_ws("-", F.lit("b"), "block", "bin").alias("container_id"), "doc_id", "part_no", "n_tokens")
    return full.union(kept).union(last)


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity, containers, least_containers, n_tokens, fill): how well the containers are filled."""
    bins = packed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("n"))
    per = bins.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    j = per.join(packs.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")), "pack_name")
    return j.select("pack_name", "capacity", "containers", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), "n_tokens", "fullest", F.round(F.col("n_tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))


def evolution_report(sizes: DataFrame, packs: DataFrame, block: int = BLOCK, generations: int = GENERATIONS, seed: int = SEED) -> DataFrame:
    """(pack_name, capacity, block, n_pieces, least_bins, best_fit_bins, evolved_bins): for each block of pack() what its documents need at
    least, what best fit from the largest on needs, and what one island needs after its generations."""
    s = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    blocks = max(1, round(s.count() / block))
    pieces = _pieces(s, packs.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).filter("capacity > 0"))
    dealt = pieces.filter("n_tokens < capacity").withColumn("block", F.pmod(F.xxhash64("doc_id", "part_no", F.lit(seed)), F.lit(blocks)))
    each = dealt.groupBy("pack_name", "capacity", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "part_no", "n_tokens"))).alias("l"))

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = [[], [], []]
            for capacity, size in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                bins[0].append(-(-sum(size) // capacity))
                bins[1].append(len(best_fit([], list(range(len(size))), size, capacity)))
                bins[2].append(len(evolve(size, capacity, [], seed, generations)))
            n = pa.array([len(x) for x in b.column(3).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], n, *[pa.array(x, pa.int32()) for x in bins]], names=["pack_name", "capacity", "block", "n_pieces", "least_bins", "best_fit_bins", "evolved_bins"])

    slim = each.select("pack_name", "capacity", "block", F.expr("transform(l, x -> x.n_tokens)").alias("sizes"))
    return slim.mapInArrow(worker, "pack_name string, capacity long, block long, n_pieces int, least_bins int, best_fit_bins int, evolved_bins int")
