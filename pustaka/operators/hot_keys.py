"""Per-key results over ordered rows where a few keys hold most of them.

Exact offset chunking. The rows are cut by their order into ranges of like size, whatever their keys. Keys are counted
per range, and the running sum of a key's counts over the ranges is the offset of its rows there; offset plus rank in
the range numbers a key's rows exactly. Chunks of equal numbers of rows are processed apart; each leaves the state at
its two ends, and a key's few states are merged in order. No task holds more of a key than a range or a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pustaka.session import cut

STATE = ("n", "first_at", "last_at", "max_gap", "first_tag", "head_run", "last_tag", "tail_run", "best_run", "runs")


def keyed(df: DataFrame, fields: tuple[str, ...], at: str, row_id: str, tag: str) -> DataFrame:
    """One row per field and row of df: (field_name, key_value, at, row_id, tag). Keys are trimmed and lower-cased; null is no key."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lower(F.trim(F.regexp_replace(F.col(f), r"^\s+|\s+$", ""))).alias("key_value")) for f in fields])
    return (
        df.select(F.explode(pairs).alias("f"), F.col(at).alias("at"), F.col(row_id).alias("row_id"), F.coalesce(F.col(tag), F.lit("")).alias("tag"))
        .select("f.*", "at", "row_id", "tag")
        .filter(F.col("key_value").isNotNull())
    )


def number_rows(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds `pos`, the exact number from 0 of each row within its (field_name, key_value), by (at, row_id), nulls first.

    Ties of `at` go by row_id; rows that repeat a row_id keep an arbitrary but fixed order, as the ranges are written
    to the shared folder before they are counted.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(ranges, "at", "row_id").withColumn("range_no", F.spark_partition_id()), "ranges")
    key = ["field_name", "key_value"]
    offsets = (
        placed.groupBy("range_no", *key)
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("offset", F.sum("c").over(Window.partitionBy(*key).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)))
        .select("range_no", *key, F.coalesce("offset", F.lit(0)).alias("offset"))
    )
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("range_no", *key).orderBy("at", "row_id")) - 1)
    return ranked.join(offsets, ["range_no", *key]).select(*key, "at", "row_id", "tag", (F.col("offset") + F.col("rank")).alias("pos"))


def _gap(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def chunk_states(numbered: DataFrame, chunk_rows: int) -> DataFrame:
    """The state of each chunk of a key: its ends, and what is known of its inside."""
    chunk = ["field_name", "key_value", "chunk"]
    by_pos = Window.partitionBy(*chunk).orderBy("pos")
    marked = (
        numbered.withColumn("chunk", F.floor(F.col("pos") / chunk_rows))
        .withColumn("gap", _gap(F.col("at"), F.lag("at").over(by_pos)))
        .withColumn("turn", F.coalesce((F.lag("tag").over(by_pos) != F.col("tag")).cast("int"), F.lit(0)))
        .withColumn("run", F.sum("turn").over(by_pos))
    )
    runs = marked.groupBy(*chunk, "run").agg(
        F.count(F.lit(1)).alias("len"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("gap").alias("gap"), F.first("tag").alias("tag")
    )
    return runs.groupBy(*chunk).agg(
        F.sum("len").alias("n"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.max("gap").alias("max_gap"),
        F.min_by("tag", "run").alias("first_tag"),
        F.min_by("len", "run").alias("head_run"),
        F.max_by("tag", "run").alias("last_tag"),
        F.max_by("len", "run").alias("tail_run"),
        F.max("len").alias("best_run"),
        F.count(F.lit(1)).alias("runs"),
    )


def _merge(a: Column, b: Column) -> Column:
    """The state of two neighbours, a before b, as one."""
    joins = a["last_tag"] == b["first_tag"]
    bridge = F.when(joins, a["tail_run"] + b["head_run"]).otherwise(F.lit(0))
    return F.struct(
        (a["n"] + b["n"]).alias("n"),
        F.least(a["first_at"], b["first_at"]).alias("first_at"),
        F.greatest(a["last_at"], b["last_at"]).alias("last_at"),
        F.greatest(a["max_gap"], b["max_gap"], _gap(b["first_at"], a["last_at"])).alias("max_gap"),
        a["first_tag"].alias("first_tag"),
        F.when(joins & (a["runs"] == 1), a["head_run"] + b["head_run"]).otherwise(a["head_run"]).alias("head_run"),
        b["last_tag"].alias("last_tag"),
        F.when(joins & (b["runs"] == 1), a["tail_run"] + b["tail_run"]).otherwise(b["tail_run"]).alias("tail_run"),
        F.greatest(a["best_run"], b["best_run"], bridge).alias("best_run"),
        (a["runs"] + b["runs"] - joins.cast("long")).alias("runs"),
    )


def merge_states(states: DataFrame, fan_in: int = 1024) -> DataFrame:
    """Merges a key's chunk states in order, fan_in neighbours at a time, until one is left."""
    key = ["field_name", "key_value"]
    most = states.agg(F.max("chunk")).first()[0] or 0
    while True:
        grouped = states.withColumn("up", F.floor(F.col("chunk") / fan_in)).groupBy(*key, "up").agg(F.array_sort(F.collect_list(F.struct("chunk", F.struct(*STATE).alias("s")))).alias("l"))
        folded = F.expr("l[0].s")
        rest = F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))
        states = grouped.select(*key, F.col("up").alias("chunk"), F.aggregate(rest, folded, lambda a, x: _merge(a, x["s"])).alias("s")).select(*key, "chunk", "s.*")
        if most < fan_in:
            return states
        most //= fan_in


def per_key(
    df: DataFrame, fields: tuple[str, ...] = ("coaching", "subject"), at: str = "submitted_at", row_id: str = "submission_id", tag: str = "prov", chunk_rows: int = 50_000, ranges: int | None = None
) -> DataFrame:
    """One row per field and key: n_rows, first_at, last_at, max_gap_s (the longest time between neighbours), n_runs and
    longest_run (stretches of rows with one tag).

    Null keys give no row, a blank one is a key; a null tag counts as ''; a null time comes first and gives no gap; an empty
    table gives an empty result. Only the named columns of df are read, so extra columns cannot clash.
    """
    states = cut(chunk_states(number_rows(keyed(df, fields, at, row_id, tag), ranges), chunk_rows), "states")
    return merge_states(states).select(
        "field_name",
        "key_value",
        F.col("n").alias("n_rows"),
        "first_at",
        "last_at",
        (F.col("max_gap") / 1_000_000).cast("long").alias("max_gap_s"),
        F.col("runs").alias("n_runs"),
        F.col("best_run").alias("longest_run"),
    )


def heavy_keys(per: DataFrame, n_rows: int, share: float = 0.05) -> DataFrame:
    """The keys of per_key() that hold at least `share` of n_rows."""
    return per.filter(F.col("n_rows") >= F.lit(share) * F.lit(n_rows)).select("field_name", "key_value")
