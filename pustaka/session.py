"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def get_spark(app: str = "pustaka", cores: str = "*", shuffle: int = 8, shared: str | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use. `shared` is the folder for tables between steps, else $PUSTAKA_SHARED;
    where neither is given, spark.checkpoint.dir stays unset, and a local session takes a temporary folder."""
    shared = shared or os.environ.get("PUSTAKA_SHARED")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PUSTAKA_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(spark, "_pustaka_shared", None) or "file://" + tempfile.mkdtemp(prefix="pustaka-")
        spark._pustaka_shared = path
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    The result no longer depends on df's lineage, so a lost executor costs no recomputation, and what depends on
    partition ids or random numbers is the same for each reader. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pustaka-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def whole(df: DataFrame) -> DataFrame:
    """A table that grows with the input, for a join that must broadcast neither side: what Spark expects of explode, of mapInArrow and of
    compressed files is a small part of the rows, and all of them would be gathered in the driver."""
    return df.hint("merge")


#: Tables that stay until the application ends, by what they were made of.
_KEPT: dict[tuple[str, str], str] = {}


def kept(spark: SparkSession, what: str, make: Callable[[str], None]) -> str:
    """The folder of a stored structure that several queries of an application read; `make` writes it where it is not there yet."""
    key = (spark.sparkContext.applicationId, what)
    if key not in _KEPT:
        path = f"{shared_dir(spark)}/pustaka-kept-{uuid.uuid4().hex}"
        make(path)
        _KEPT[key] = path
    return _KEPT[key]


def drop_cuts(since: int = 0) -> None:
    """Deletes the tables that cut() wrote, or those it wrote after the first `since`; results that still read them must be written before."""
    while len(_MADE) > since:
        spark, path = _MADE.pop()
        context = spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():  # the session is gone, and its temporary tables with it
            continue
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tables_for_one_query() -> Iterator[None]:
    """Drops at its end the tables that were cut within it, so that a long session does not fill the disk; the result is written inside."""
    before = len(_MADE)
    try:
        yield
    finally:
        drop_cuts(before)


def _at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            _MADE.extend((spark, path) for path in _KEPT.values())
        drop_cuts()
    except Exception:  # the JVM may have ended first; nothing else can be done then
        pass


atexit.register(_at_exit)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the project's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
