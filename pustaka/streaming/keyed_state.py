"""State by key over ordered events: as windows over a finished table, and as streams with the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A link is down at so many failures in a row.
DOWN_AT = 2
STATE = "misses int, down boolean, n_up long, n_missed long, n_newly_down long, n_still_down long, n_recovered long"


def health(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """(key, n_up, n_missed, n_newly_down, n_still_down, n_recovered, is_down): what the checks of each link came to.

    A failure counts as missed until DOWN_AT of them follow each other; from then on the link is down, until a check succeeds.
    """
    by = Window.partitionBy(key).orderBy(*order)
    e = events.select(key, *order, failed.cast("int").alias("failed"))
    e = e.withColumn("island", F.sum(1 - F.col("failed")).over(by))
    e = e.withColumn("misses", F.sum("failed").over(Window.partitionBy(key, "island").orderBy(*order)))
    e = e.withColumn("before", F.coalesce(F.lag("misses").over(by), F.lit(0)))
    f, m, b = F.col("failed") == 1, F.col("misses"), F.col("before")
    last = F.struct(*order)
    return e.groupBy(key).agg(
        F.count_if(~f & (b < DOWN_AT)).alias("n_up"),
        F.count_if(f & (m < DOWN_AT)).alias("n_missed"),
        F.count_if(f & (m == DOWN_AT)).alias("n_newly_down"),
        F.count_if(f & (m > DOWN_AT)).alias("n_still_down"),
        F.count_if(~f & (b >= DOWN_AT)).alias("n_recovered"),
        (F.max_by("misses", last) >= DOWN_AT).alias("is_down"),
    )


def health_stream(events: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """As health(), over a stream: one row per link and batch, with the counts so far. Within a batch events go by `order`;
    a batch must not hold events older than those before it."""
    out = f"{key} long, n_up long, n_missed long, n_newly_down long, n_still_down long, n_recovered long, is_down boolean"

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        misses, down, up, missed, newly, still, recovered = state.get if state.exists else (0, False, 0, 0, 0, 0, 0)
        pdf = pd.concat(list(batches)).sort_values("__order")
        for bad in pdf["__failed"]:
            if bad:
                misses += 1
                missed += misses < DOWN_AT
                newly += misses == DOWN_AT
                still += misses > DOWN_AT
            else:
                recovered += misses >= DOWN_AT
                up += misses < DOWN_AT
                misses = 0
        down = misses >= DOWN_AT
        state.update((int(misses), bool(down), int(up), int(missed), int(newly), int(still), int(recovered)))
        yield pd.DataFrame([[k[0], up, missed, newly, still, recovered, down]], columns=[c.split()[0] for c in out.split(", ")])

    slim = events.select(F.col(key), F.col(order).alias("__order"), failed.cast("int").alias("__failed"))
    return slim.groupBy(key).applyInPandasWithState(step, out, STATE, "update", GroupStateTimeout.NoTimeout)


def streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """(key, n_days, longest, last_run): different days, the longest stretch of days in a row, and the last one's length."""
    d = days.select(key, F.col(day).alias("d")).distinct()
    runs = d.withColumn("island", F.date_sub("d", F.row_number().over(Window.partitionBy(key).orderBy("d")))).groupBy(key, "island").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("end"))
    return runs.groupBy(key).agg(F.sum("n").alias("n_days"), F.max("n").alias("longest"), F.max_by("n", "end").alias("last_run"))


def due_again(events: DataFrame, key: str, at: str, failed: Column, ok: Column, days: int = 7) -> DataFrame:
    """(key, last_failed, due): links whose last failure lies `days` back from the newest event, without a success since."""
    newest = events.agg(F.max(at)).first()[0]
    g = events.groupBy(key).agg(F.max(F.when(failed, F.col(at))).alias("last_failed"), F.max(F.when(ok, F.col(at))).alias("last_ok"))
    late = F.col("last_failed") <= F.lit(newest) - F.expr(f"INTERVAL {days} DAYS")
    return g.filter("last_failed IS NOT NULL").select(key, "last_failed", (late & (F.col("last_ok").isNull() | (F.col("last_ok") < F.col("last_failed")))).alias("due"))


def tumbling(events: DataFrame, at: str, kind: str, width: str, late: str | None = None) -> DataFrame:
    """(start, kind, n): counts in windows of a width; on a stream, with a watermark of `late`."""
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, end, n): stretches of a key's events with less than a gap between neighbours."""
    g = events.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last_at"))
    return g.select(key, F.col("s.start").alias("start"), "last_at", "n")


#: States of a file's life, and where each event takes it: a failure counts, and the third is the last. Fixed values.
LIFE = ("pending", "failed 1", "failed 2", "failed 3", "ok", "gone", "archived")
MOVES = {
    "fetched": (4, 4, 4, 3, 4, 5, 6),
    "failure": (1, 2, 3, 3, 4, 5, 6),
    "missing": (5, 5, 5, 3, 5, 5, 6),
    "saved": (0, 1, 2, 3, 6, 6, 6),
    "verify": (0, 0, 0, 0, 0, 0, 6),
}
#: Events of a key that are put together in one step.
CHUNK = 10_000


def lifecycle(events: DataFrame, key: str, order: list[str], event: Column, chunk: int = CHUNK) -> DataFrame:
    """(key, state, n_events): where its events, in order, bring each file; events of other names leave it where it is.

    An event is a map from states to states, and maps are put together in any grouping: first those of each stretch of a key's events, then
    those of the stretches. So no task holds more than `chunk` events of a key, nor more than a key's stretches.
    """
    table = F.array(*[F.array(*[F.lit(x) for x in m]) for m in (tuple(range(len(LIFE))), *MOVES.values())])
    no = F.lit(0)
    for i, name in enumerate(MOVES):
        no = F.when(event == name, i + 1).otherwise(no)
    e = events.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("__at"), no.alias("__no"))
    start = F.array(*[F.lit(i) for i in range(len(LIFE))])
    then = lambda maps: F.aggregate(maps, start, lambda acc, x: F.transform(acc, lambda s: F.get(x, s)))
    parts = e.groupBy(key, F.floor((F.col("__at") - 1) / chunk).alias("__part")).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("__at", "__no"))), lambda x: F.get(table, x["__no"])).alias("maps"))
    steps = parts.select(key, "__part", "n", then(F.col("maps")).alias("map"))
    whole = steps.groupBy(key).agg(F.sum("n").alias("n_events"), F.transform(F.array_sort(F.collect_list(F.struct("__part", "map"))), lambda x: x["map"]).alias("maps"))
    return whole.select(key, F.get(F.array(*[F.lit(s) for s in LIFE]), F.get(then(F.col("maps")), F.lit(0))).alias("state"), "n_events")


def lifecycle_stream(events: DataFrame, key: str, order: str, event: Column) -> DataFrame:
    """As lifecycle(), over a stream: one row per key and batch. Within a batch events go by `order`; a batch must not hold events older than those before it."""
    moves, states = dict(MOVES), LIFE

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, n = state.get if state.exists else (0, 0)
        for name in pd.concat(list(batches)).sort_values("__order")["__event"]:
            at = moves[name][at] if name in moves else at
            n += 1
        state.update((int(at), int(n)))
        yield pd.DataFrame([[k[0], states[at], n]], columns=[key, "state", "n_events"])

    slim = events.select(F.col(key), F.col(order).alias("__order"), event.alias("__event"))
    return slim.groupBy(key).applyInPandasWithState(step, f"{key} long, state string, n_events long", "at int, n long", "update", GroupStateTimeout.NoTimeout)


def resume(stream: DataFrame, key: list[str], done: str, work, checkpoint: str):
    """Works a stream of pages off, each once: what is in the table `done` (by key) is passed over, and what a batch gives is added to it with the
    batch's number, so that a batch that is repeated after a failure replaces its own rows. `work` takes and gives a DataFrame with the key."""

    def batch(df: DataFrame, no: int) -> None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(done)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        fresh = df.dropDuplicates(key)
        if there:
            fresh = fresh.join(spark.read.parquet(done).filter(F.col("batch") != no).select(*key), key, "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{done}/batch={no}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seen_ring(events: DataFrame, key: str, order: list[str], item: str, size: int = 600) -> DataFrame:
    """(key, item): the last `size` different items of each key; Spark keeps no more of a key in any task."""
    last = events.groupBy(key, item).agg(F.max(F.struct(*order)).alias("__last"))
    return last.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__last"), item))).filter(F.col("__k") <= size).select(key, item)
