"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import importlib

import pytest
from conftest import DATA, same_rows, tables

import pustaka.plans

PLANS = [importlib.import_module(f"pustaka.plans.{m}") for m in pustaka.plans.MODULES]
QUERIES = {n: f for m in PLANS for n, f in m.QUERIES.items()}
ORACLE = {n: s for m in PLANS for n, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    same_rows(QUERIES[name](spark, DATA), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
