"""Every core query with SQL equals DuckDB's result; every other one runs with a stable schema."""

import importlib

import oracle
import pytest

import __spark_entry__ as entry

CORE = [importlib.import_module(m) for m in entry._CORE]
QUERIES = {k: v for m in CORE for k, v in m.QUERIES.items()}
SQL = {k: v for m in CORE for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, name):
    assert oracle.difference(QUERIES[name](spark, small), small, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
