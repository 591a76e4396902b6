"""Every registered query against its SQL on DuckDB, row by row."""

import pytest

import __spark_entry__ as entry_points
import compare
from tillroll.plans import catalog, oracle

QUERIES = catalog.registered()
SQL = oracle.statements()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, duck):
    names, rows = compare.spark_rows(QUERIES[name](spark, sf_dir))
    expected_names, expected = compare.duck_rows(duck, SQL[name])
    assert names == expected_names
    assert len(rows) == len(expected)
    assert rows == expected


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
