"""The queries that SQL can express against DuckDB, row by row."""

import compare
import pytest

from tillroll.llm import catalog


@pytest.mark.parametrize("name", list(catalog.statements()))
def test_query(name, spark, sf_dir):
    duck = compare.connect(sf_dir)
    names, rows = compare.spark_rows(catalog.registered()[name](spark, sf_dir))
    expected_names, expected = compare.duck_rows(duck, catalog.statements()[name])
    assert (names, rows) == (expected_names, expected)
