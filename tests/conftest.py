"""One small session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
os.environ.setdefault("PUSTAKA_DRIVER_MEMORY", "4g")
# small tables: compiling costs more than it saves
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-java-options '-XX:TieredStopAtLevel=1 -XX:+UseParallelGC' --conf spark.sql.codegen.wholeStage=false pyspark-shell")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pustaka.session import get_spark

    s = get_spark("tests", cores="4", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    """A value in a form in which Spark's and DuckDB's compare."""
    import datetime
    import math

    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def tables(folder: str = DATA):
    """A DuckDB connection with the tables as views."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def same_rows(df, con, sql: str) -> None:
    """Asserts that a DataFrame and a query give the same columns and rows."""
    from collections import Counter

    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
