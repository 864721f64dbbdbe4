"""Every registered query against its DuckDB text on the smallest data."""

import pytest
from compare import compare, duck
from conftest import SF

import __spark_entry__ as entry
from visitmill.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, con):
    problem, _ = compare(spark, con, QUERIES[name], SQL.get(name), SF)
    assert problem is None


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry_registers_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "pv", "uv", "pv_percent", "uv_percent"]
