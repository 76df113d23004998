"""Writing a corpus: size-bounded parts that stay the same where their rows do, the index by bucket, CSV text, and a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.functions import text as T

#: Bytes of text a part aims at.
PART_BYTES = 600_000


def with_parts(questions: DataFrame, refs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Adds `anchor`, the least copy a question stands in, and `part`: its hash, modulo the number of parts its paper needs.

    A question's part depends on its anchor and on the size of its paper only, so that adding a question leaves all others in place.
    """
    a = questions.join(refs.groupBy("qid").agg(F.min("base").alias("anchor")), "qid", "left")
    n = questions.groupBy("paper").agg(F.greatest(F.ceil(F.sum(F.octet_length("text")) / part_bytes), F.lit(1)).alias("n_parts"))
    return a.join(n, "paper").withColumn("part", F.coalesce(T.fnv32(F.col("anchor")), F.lit(0)) % F.col("n_parts"))


def write_parts(parts: DataFrame, path: str) -> None:
    """One folder per paper and part; rows by text. A part's files depend on its rows only."""
    parts.repartition("paper", "part").sortWithinPartitions("paper", "part", "norm").write.mode("overwrite").partitionBy("paper", "part").parquet(path)


def write_index(postings: DataFrame, path: str) -> None:
    """The postings by bucket; a query for a word reads one folder."""
    postings.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def manifest(parts: DataFrame) -> DataFrame:
    """(paper, part, n_rows, n_bytes, digest): what each part holds. The digest is of the sorted digests of its texts; a part is of bounded size."""
    d = parts.groupBy("paper", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("text")).alias("n_bytes"), F.array_sort(F.collect_list(F.sha2("text", 256))).alias("d"))
    return d.select("paper", "part", "n_rows", "n_bytes", F.sha2(F.array_join("d", ""), 256).alias("digest"))


def csv_field(c: Column) -> Column:
    """A field for CSV: quoted where it holds a comma, a quote or a line break, quotes doubled."""
    x = T.blank(c)
    return F.when(x.rlike("[\",\n\r]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_lines(df: DataFrame, columns: list[str]) -> Column:
    """The columns of a row as a line of CSV."""
    return F.concat_ws(",", *[csv_field(F.col(c).cast("string")) for c in columns])


def nested_by(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, n, doc): the rows of each key as a JSON array in an order, without fields that have no value. A key's rows are a person's copies, which
    are few; a key that is not so bounded belongs in a table."""
    one = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.to_json(F.struct(*fields)).alias("j"))
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(one)).alias("l"))
    return g.select(key, "n", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("doc"))


def write_map(rows: DataFrame, key: str, fields: list[str], path: str) -> None:
    """One JSON map, an entry on a line of its own, in the order of the keys; the committer puts the file in its place as a whole."""
    entry = F.concat(F.to_json(F.array(F.col(key))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key)))) - 2), F.lit(": "), F.to_json(F.struct(*fields)))
    lines = rows.select(key, entry.alias("value")).orderBy(key)
    last = rows.agg(F.max(key).alias("last"))
    first = rows.agg(F.min(key).alias("first"))
    body = lines.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(first))
    text = F.concat(F.when(F.col(key) == F.col("first"), "{").otherwise(" "), "value", F.when(F.col(key) == F.col("last"), "}").otherwise(","))
    body.coalesce(1).sortWithinPartitions(key).select(text.alias("value")).write.mode("overwrite").text(path)


def read_map(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The entries of a JSON map of any layout: (key, fields); names that begin with _ are notes and no entries. A missing file has none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{key} string, {schema}")
    whole = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"MAP<STRING, STRUCT<{', '.join(c.strip().replace(' ', ': ', 1) for c in schema.split(', '))}>>")
    return whole.select(F.explode(m).alias(key, "v")).filter(~F.startswith(key, F.lit("_"))).select(key, "v.*")


def write_dataset(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Writes each table as CSV and as JSON in folders of its name, and gives the manifest: (name, form, n_rows, n_files, n_bytes, sha256), the
    rows being those that are read again."""
    from pustaka.sources.loaders import digests

    out = None
    for name, df in tables.items():
        for form in ("csv", "json"):
            at = f"{path}/{name}.{form}"
            options = {"header": True, "quote": '"', "escape": '"'} if form == "csv" else {}
            df.write.format(form).options(**options).save(at)
            back = spark.read.format(form).options(**options, multiLine=form == "csv").schema(df.schema).load(at)
            one = digests(spark, at).crossJoin(back.agg(F.count(F.lit(1)).alias("n_rows"))).select(F.lit(name).alias("name"), F.lit(form).alias("form"), "n_rows", "n_files", "n_bytes", "sha256")
            out = one if out is None else out.union(one)
    return out
