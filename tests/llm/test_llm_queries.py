"""Every query of the subpackage: against its SQL where there is one, else that it gives rows."""

from __future__ import annotations

import importlib
import re
from pathlib import Path

import pytest
from conftest import DATA, same_rows, tables

import pustaka
from pustaka.llm import QUERY_MODULES

PLANS = [importlib.import_module(f"pustaka.llm.{m}") for m in QUERY_MODULES]
QUERIES = {n: f for m in PLANS for n, f in m.QUERIES.items()}
ORACLE = {n: s for m in PLANS for n, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    same_rows(QUERIES[name](spark, DATA), tables(), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_nothing_outside_imports_the_subpackage():
    root = Path(pustaka.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"pustaka\.llm|from \.llm|import llm", f.read_text()), f
