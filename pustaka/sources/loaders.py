"""Readers of files: CSV with named columns and a provenance, JSON lists, and listings of what a folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.functions import text as T
from pustaka.sources.csv_records import COLUMNS, leading_int

LOADED = ", ".join(f"{c} string" for c in COLUMNS if c != "page_number") + ", page int, prov string"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load_csv(spark: SparkSession, path: str, prov: str) -> DataFrame:
    """The rows of CSV files under their column names, in whatever order the header states them, trimmed, with the page as a number and the
    provenance. Rows of fewer fields than the header and rows without a value are dropped, more fields than it names are ignored; line
    ends may be LF, CR or both, and quoted fields may hold them. A missing file has no rows, a missing column no values.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], LOADED)
    named = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    has = {c.strip().lower(): c for c in named.columns}
    schema = ", ".join(f"`{c}` string" for c in named.columns) + ", __bad string"
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=schema, columnNameOfCorruptRecord="__bad", mode="PERMISSIVE", enforceSchema=True)
    last = F.col(f"`{named.columns[-1]}`")
    # a corrupt record is one of too few or too many fields; only the former lacks the last one
    rows = raw.filter(F.col("__bad").isNull() | last.isNotNull())
    value = lambda c: F.trim(F.coalesce(F.col(f"`{has[c]}`"), F.lit(""))) if c in has else F.lit("")
    rows = rows.select(*[value(c).alias(c) for c in COLUMNS])
    rows = rows.filter(F.concat(*COLUMNS) != "")
    return rows.select(*[c for c in COLUMNS if c != "page_number"], leading_int(F.col("page_number")).alias("page"), F.lit(prov).alias("prov"))


def load_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON file of the form {"entries": [...]}; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    shape = "entries ARRAY<STRUCT<" + ", ".join(c.strip().replace(" ", ": ", 1) for c in schema.split(", ")) + ">>"
    return spark.read.json(path, schema=shape, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(key, bytes): the files below a folder; only their names and lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(T.url_base(F.element_at(F.split("path", "/"), -1)).alias("key"), F.col("length").alias("bytes"))


def digests(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """(n_files, n_bytes, sha256): of a written table; the digest is of the sorted digests of its files, which are of bounded size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("length", F.sha2("content", 256).alias("d"))
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("sha256"))
