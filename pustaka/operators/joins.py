"""Join shapes of the corpus: filters by list, rewriting by map, merging of two views of a thing, lookup by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without(rows: DataFrame, deny: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not on a list; null keys are on no list."""
    return rows.join(deny.select(*on).distinct(), on, "left_anti")


def rewrite(rows: DataFrame, key: Column, moves: DataFrame) -> DataFrame:
    """Adds `moved`: where the key of a row has gone, by moves (old, new), or null."""
    first = moves.groupBy("old").agg(F.min("new").alias("moved"))
    return rows.withColumn("old", key).join(first, "old", "left").drop("old")


def merged(left: DataFrame, right: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Both sides by key: what the right side states counts before what the left does; a side that lacks a key is filled from the other."""
    r = right.select(on, *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(True).alias("r"))
    j = left.select(on, *fields, F.lit(True).alias("l")).join(r, on, "full_outer")
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right")
    return j.select(on, *[F.coalesce(f"r_{f}", f).alias(f) for f in fields], side.alias("side"))


def in_ranges(rows: DataFrame, value: str, starts: DataFrame, start: str, label: str) -> DataFrame:
    """Adds the label of the last range that starts at or before a value, without a join of every pair: both sides in one order.

    The running maximum is taken within buckets of values, and across buckets from the last start of an earlier one, so
    that no task sorts all rows.
    """
    both = rows.select(F.col(value).alias("v"), F.struct(*rows.columns).alias("row"), F.lit(None).cast(starts.schema[label].dataType).alias("lab"), F.lit(1).alias("kind")).unionByName(
        starts.select(F.col(start).alias("v"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("row"), F.col(label).alias("lab"), F.lit(0).alias("kind"))
    )
    both = both.withColumn("bucket", F.floor(F.col("v") / (1 << 20)))
    own = F.last("lab", ignorenulls=True).over(Window.partitionBy("bucket").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0))
    ends = starts.groupBy(F.floor(F.col(start) / (1 << 20)).alias("bucket")).agg(F.max_by(label, start).alias("end"))
    buckets = both.select("bucket").distinct().join(ends, "bucket", "left")
    before = buckets.withColumn("before", F.last("end", ignorenulls=True).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", "before")
    found = both.withColumn("own", own).filter("kind = 1").join(before, "bucket")
    return found.select("row.*", F.coalesce("own", "before").alias(label))


def paired(old: DataFrame, new: DataFrame, on: list[str], old_order: list[str], new_order: list[str]) -> DataFrame:
    """Groups of both sides whose counts agree, their members paired by place: (on, n_old, n_new, outcome, n_pairs)."""
    a = old.groupBy(*on).agg(F.count(F.lit(1)).alias("n_old"))
    b = new.groupBy(*on).agg(F.count(F.lit(1)).alias("n_new"))
    j = a.join(b, on, "full_outer").na.fill(0, ["n_old", "n_new"])
    outcome = F.when(F.col("n_new") == 0, "no new").when(F.col("n_old") == 0, "fresh").when(F.col("n_old") == F.col("n_new"), "paired").otherwise("count mismatch")
    return j.select(*on, "n_old", "n_new", outcome.alias("outcome"))


def pairs_by_place(old: DataFrame, new: DataFrame, on: list[str], old_id: str, new_id: str) -> DataFrame:
    """(on, old_id, new_id): the i-th of one side with the i-th of the other, in groups of like count."""
    rank = lambda d, c: d.withColumn("place", F.row_number().over(Window.partitionBy(*on).orderBy(c))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    return rank(old, old_id).join(rank(new, new_id), [*on, "place", "n"]).select(*on, old_id, new_id)


# How addresses of a file service are written.
DRIVE_FILE, DRIVE_FOLDER, DRIVE_OPEN = r"drive\.google\.com/file/d/([^/?]+)", r"drive\.google\.com/(?:drive/(?:u/\d+/)?folders|drive/folders)/([^/?]+)", r"drive\.google\.com/open\?id=([^&]+)"
DRIVE_FETCH = "https://drive.google.com/uc?export=download&id="


def fetched_from(url: Column, moved: Column) -> list[Column]:
    """[fetch_url, note]: where a link is fetched from; a folder has to be listed first and has no address of its own."""
    one = lambda p: F.concat(F.lit(DRIVE_FETCH), F.regexp_extract(url, p, 1))
    to = F.when(moved.isNotNull(), moved).when(url.rlike(DRIVE_FILE), one(DRIVE_FILE)).when(url.rlike(DRIVE_FOLDER), F.lit(None).cast("string")).when(url.rlike(DRIVE_OPEN), one(DRIVE_OPEN)).otherwise(url)
    note = F.when(moved.isNotNull(), "moved").when(url.rlike(DRIVE_FILE), "drive-file").when(url.rlike(DRIVE_FOLDER), "drive-folder").when(url.rlike(DRIVE_OPEN), "drive-open").otherwise("direct")
    return [to.alias("fetch_url"), note.alias("note")]


def outcomes(old: DataFrame, new: DataFrame, on: list[str], old_id: str, new_id: str) -> DataFrame:
    """(on, old_id, new_id, outcome): what becomes of each old member, and the new ones of groups that had none.

    The i-th old one goes with the i-th new one where a group has as many of both, unless their years (old_year, new_year) differ or
    the new one is not available: paired, year mismatch, no file, count mismatch, no new, fresh.
    """
    rank = lambda d, c, n: d.withColumn("place", F.row_number().over(Window.partitionBy(*on).orderBy(c))).withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*on)))
    sizes = new.groupBy(*on).agg(F.count(F.lit(1)).alias("size"))
    j = rank(old, old_id, "n_old").join(sizes, on, "left").join(rank(new, new_id, "n_new").drop("n_new"), [*on, "place"], "left")
    why = (
        F.when(F.col("size").isNull(), "no new")
        .when(F.col("size") != F.col("n_old"), "count mismatch")
        .when(F.col("old_year").isNotNull() & ~F.col("old_year").eqNullSafe(F.col("new_year")), "year mismatch")
        .when(~F.col("available"), "no file")
        .otherwise("paired")
    )
    fresh = new.join(old.select(*on).distinct(), on, "left_anti").select(*on, F.lit(None).cast(old.schema[old_id].dataType).alias(old_id), new_id, F.lit("fresh").alias("outcome"))
    return j.select(*on, old_id, F.when(why == "paired", F.col(new_id)).alias(new_id), why.alias("outcome")).unionByName(fresh)
