"""Orders, places and pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _with_text(df: DataFrame, text: str) -> StructType:
    """The columns of df and a text."""
    return StructType([*df.schema.fields, StructField(text, StringType())])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows of each group. Spark keeps k rows of a group in each task before the groups are brought together."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= k)


def places(df: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """Numbers all rows from 1 in an order, without bringing them into one task: range partitions, their sizes summed up, and a rank within each."""
    from pustaka.session import cut

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = cut(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "places")
    sizes = p.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return p.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order))).join(before, "__p").withColumn(place, F.col("__before") + F.col("__r")).drop("__p", "__r", "__before")


def pages(df: DataFrame, order: list[str], label: str, size: int = 200) -> DataFrame:
    """(page_no, first_label, last_label, n): pages of `size` rows in an order."""
    p = places(df, order).withColumn("page_no", F.floor((F.col("place") - 1) / size) + 1)
    return p.groupBy("page_no").agg(F.min_by(label, "place").alias("first_label"), F.max_by(label, "place").alias("last_label"), F.count(F.lit(1)).alias("n"))


def round_robin(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds `turn` and `slot`: the first of each group in the order in which groups appear, then the second of each, and so on."""
    first = df.groupBy(group).agg(F.min(order).alias("seen"))
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order))).join(first, group)
    return places(ranked, ["turn", "seen"], "slot").drop("seen")


def within_capacity(df: DataFrame, by: list[str], order: list[str], size: str, capacity: float) -> DataFrame:
    """Adds the running sum of a size within groups, and whether it stays within a capacity."""
    run = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", run).withColumn("kept", F.col("running") <= capacity)


def unique_slugs(df: DataFrame, slug: str, order: str) -> DataFrame:
    """Adds `unique_slug`: in the order of the rows, each takes its slug, or the first of slug-2, slug-3 and so on that no earlier row has taken.

    What a row takes depends only on rows of its family, the slugs that are one after closing numbers are taken off; so a family is numbered
    in order by itself. A slug whose family has no other slug is numbered by its place alone, however many rows it has; only families in which
    slugs can meet are walked through, and of these only rows of slugs that another one of the family can be taken for.
    """
    stem = F.regexp_replace(slug, r"(?:-\d+)+$", "")
    kinds = df.select(slug, stem.alias("__stem")).distinct().groupBy("__stem").agg(F.count(F.lit(1)).alias("__kinds")).filter("__kinds > 1").select("__stem", F.lit(True).alias("__mixed"))
    d = df.withColumn("__stem", stem).join(kinds, "__stem", "left")
    alone = d.filter("__mixed IS NULL").withColumn("__k", F.row_number().over(Window.partitionBy(slug).orderBy(order)))
    alone = alone.withColumn("unique_slug", F.when(F.col("__k") == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), F.col("__k")))).drop("__k", "__stem", "__mixed")
    out, columns = _with_text(df, "unique_slug"), list(df.columns)

    def walk(batches):
        taken: set[str] = set()
        after: dict[str, int] = {}
        family = None
        for b in batches:
            made = []
            for f, s in zip(b.column(b.schema.get_field_index("__stem")).to_pylist(), b.column(b.schema.get_field_index(slug)).to_pylist(), strict=True):
                if f != family:
                    family, taken, after = f, set(), {}
                new = s
                while new in taken:
                    after[s] = after.get(s, 1) + 1
                    new = f"{s}-{after[s]}"
                taken.add(new)
                made.append(new)
            keep = [b.column(b.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(made, pa.string())], names=[*columns, "unique_slug"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = d.filter("__mixed").drop("__mixed").repartition(parts, "__stem").sortWithinPartitions("__stem", order).mapInArrow(walk, out)
    return alone.select(*df.columns, "unique_slug").union(mixed)


def alike_in_group(left: DataFrame, right: DataFrame, group: str, row_id: str, page: str, words: str, near: float, far: float) -> DataFrame:
    """(row_id, hit): the rows of the left side whose words overlap (shared by all) with those of a row of the right side of their group by `near` on the
    same page, or by `far` anywhere in the group.

    Of n words, the rarest n - ceil(near * n) + 1 are tried, one of which any such partner holds; rare words keep a large group's pairs few.
    """
    both = left.select(group, words).union(right.select(group, words))
    freq = both.select(group, F.explode(words).alias("word")).groupBy(group, "word").agg(F.count(F.lit(1)).alias("c"))

    def tried(df: DataFrame) -> DataFrame:
        each = df.select(group, row_id, F.size(words).alias("n"), F.explode(words).alias("word")).join(freq, [group, "word"])
        rarest = each.groupBy(group, row_id, "n").agg(F.array_sort(F.collect_list(F.struct("c", "word"))).alias("l"))
        return rarest.select(group, row_id, F.explode(F.slice("l", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(near)) + 1).cast("int"))).alias("x")).select(group, row_id, "x.word")

    pairs = tried(left).withColumnRenamed(row_id, "__a").join(tried(right).withColumnRenamed(row_id, "__b"), [group, "word"]).select("__a", "__b").distinct()
    full = pairs.join(left.select(F.col(row_id).alias("__a"), F.col(page).alias("__pa"), F.col(words).alias("__wa")), "__a").join(right.select(F.col(row_id).alias("__b"), F.col(page).alias("__pb"), F.col(words).alias("__wb")), "__b")
    shared = F.size(F.array_intersect("__wa", "__wb"))
    least = F.when(F.col("__pa") == F.col("__pb"), F.lit(near)).otherwise(F.lit(far)).cast("decimal(5,4)")
    return full.filter(shared >= least * (F.size("__wa") + F.size("__wb") - shared)).select(F.col("__a").alias(row_id)).distinct().withColumn("hit", F.lit(True))
