"""Mixing sources to target shares of all tokens.

Pivotal dependent rounding. The mixture is as large as the scarcest source allows; so each source needs a number of
copies per document, whose whole part every document gets and whose fraction is a probability. Two documents with
fractional probabilities are paired, and mass, counted in tokens, is moved at random from one to the other until one of
them is 0 or 1; the expected number of copies of each stays what it was, and the tokens of the pair stay exactly the
same. What is left of a task, one document a source, goes up a reduction tree, so that in the end a source is off by a
part of one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pustaka.session import cut

#: Residuals that one task of the reduction tree pairs, at most.
FAN_IN = 2000
#: A source takes part with at least so many decimals of a fraction; closer to 0 or 1 counts as whole.
EXACT = 1e-9
SEED = 5


def _chance(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number between 0 and 1 for each document, the same in every run."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


class _Rounder:
    """Pairs the documents of a source as they come; at most one of each source stays fractional."""

    def __init__(self) -> None:
        self.open: dict[str, list] = {}

    def add(self, source: str, doc: int, size: int, p: float, u: float) -> list[tuple]:
        """The documents that become whole by this one: (doc, source, size, 0 or 1)."""
        out = []
        if size <= 0 or p <= EXACT or p >= 1 - EXACT:
            return [(doc, source, size, int(p > 0.5 if size > 0 else u < p))]
        if source not in self.open:
            self.open[source] = [doc, size, p]
            return out
        d, s, q = self.open.pop(source)
        # mass in tokens: to this one up to its room or all the other has, or the other way round
        give = min(q * s, (1 - p) * size)
        take = min((1 - q) * s, p * size)
        if u * (give + take) < take:
            q, p = q - give / s, p + give / size
        else:
            q, p = q + take / s, p - take / size
        left = []
        for x, n, r in ((d, s, q), (doc, size, p)):
            if r <= EXACT or r >= 1 - EXACT:
                out.append((x, source, n, int(r > 0.5)))
            else:
                left.append([x, n, r])
        if left:
            self.open[source] = left[0]
        return out


_ROUNDED = "doc_id long, source string, n_tokens long, extra int, p double"


def _worker(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    r = _Rounder()
    names = [x.split()[0] for x in _ROUNDED.split(", ")]

    def batch(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    for b in batches:
        docs = b.column(0).to_numpy(zero_copy_only=False)
        rows = zip(docs.tolist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), _chance(docs, seed).tolist(), strict=True)
        out = [(*x, None) for d, s, n, p, u in rows for x in r.add(s, d, n, p, u)]
        if out:
            yield batch(out)
    if r.open:
        yield batch([(d, s, n, None, p) for s, (d, n, p) in r.open.items()])


def round_copies(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, extra): the fractions p of (doc_id, source, n_tokens, p) made whole, the tokens of each source kept."""
    level, tasks = 0, None
    done = None
    while True:
        # the largest come first, so that what is left fractional in the end is small
        step = cut(rows.select("doc_id", "source", "n_tokens", "p").sortWithinPartitions(F.desc("n_tokens"), "doc_id").mapInArrow(lambda it, k=level: _worker(it, seed + k), _ROUNDED), "rounded")
        whole = step.filter("p IS NULL").select("doc_id", "source", "n_tokens", "extra")
        done = whole if done is None else done.union(whole)
        rest = step.filter("p IS NOT NULL")
        n = rest.groupBy("source").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c"), F.sum("c")).first()
        if not n[0] or n[0] <= 1:
            u = F.rand(seed)
            return done.union(rest.select("doc_id", "source", "n_tokens", (u < F.col("p")).cast("int").alias("extra")))
        tasks = max(1, n[1] // FAN_IN if tasks is None or n[1] // FAN_IN < tasks else tasks // 2)
        rows, level = rest.repartition(tasks, F.pmod(F.xxhash64("doc_id"), F.lit(tasks))), level + 1


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, per_doc): how many copies of a document each source needs on average.

    The total is the largest that no source's tokens, times its repeats, fall short of. A source of null or negative
    share, without tokens or without repeats takes no part, and the shares of the others are scaled up to 1.
    """
    have = sizes.filter("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = cut(t.join(have, "source").filter("available > 0 AND target_share > 0 AND max_repeats > 0"), "targets")
    whole = j.agg(F.sum("target_share").alias("all"), F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("unit")).first()
    # unit is the total for shares that sum to 1; it needs no scaling, as shares only count against each other
    per_doc = F.least(F.lit(whole["unit"]) * F.col("target_share") / F.col("available"), F.col("max_repeats").cast("double"))
    return j.select("source", (F.col("target_share") / F.lit(whole["all"])).alias("target_share"), "max_repeats", "available", per_doc.alias("per_doc"))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document of a targeted source is used; documents not used have 0.

    sizes: (doc_id, source, n_tokens); targets: (source, target_share, max_repeats), a small table. No document is used
    more often than its source's max_repeats. Documents of null or untargeted sources give no row; those without tokens
    are drawn by their probability alone; repeated rows are drawn apart; empty tables give an empty result. A source
    that holds most documents is rounded in every task that holds some of it.
    """
    p = plan(sizes, targets)
    whole = F.floor(F.col("per_doc") + EXACT)
    rows = sizes.filter("source IS NOT NULL").join(p.select("source", "per_doc"), "source").select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), whole.cast("int").alias("base"), F.greatest(F.col("per_doc") - whole, F.lit(0.0)).alias("p"))
    base = rows.select("source", "base").groupBy("source").agg(F.max("base").alias("base"))
    return round_copies(rows, seed).join(base, "source").select("doc_id", "source", "n_tokens", (F.col("base") + F.col("extra")).alias("copies"))


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_docs, n_used, most_copies, max_repeats, mixed_tokens): the shares that came out."""
    per = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("copies") > 0).alias("n_used"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens")
    )
    total = per.agg(F.sum("mixed_tokens").alias("total")).first()["total"]
    j = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").withColumn("total", F.lit(total).cast("double"))
    return j.select("source", "target_share", F.round(F.coalesce("mixed_tokens", F.lit(0)) / F.col("total"), 6).alias("actual_share"), "n_docs", "n_used", "most_copies", "max_repeats", "mixed_tokens")
