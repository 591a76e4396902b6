"""Clean lines that are compared by fingerprint, written in order once, and numbered by their places."""

import re

import pytest
from pyspark.sql import functions as F

from tillroll.functions import ranking
from tillroll.operators import cleaning, entities
from tillroll.plans.workspace import Workspace


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("most", [2_000_000, 0])
@pytest.mark.parametrize("ignore", [[], ["label"]])
def test_copies_of_written_rows(spark, monkeypatch, most, ignore):
    monkeypatch.setattr(cleaning, "_REPEATED", most)
    held = [(1, "a", "x"), (1, "a", "x"), (1, None, "x"), (1, None, "x"), (None, None, "y"), (2, "b", "z"), (2, "b", "y")]
    df = spark.createDataFrame(held * 3 + [(3, "c", "x")], "k int, text string, label string")
    found = cleaning.drop_copies_of_written(df, ignore=ignore)
    assert rows(found) == rows(cleaning.drop_exact_duplicates(df, ignore=ignore))
    assert found.columns == df.columns and found.count() == (5 if ignore else 6)


def test_rows_that_share_a_fingerprint_both_stay(spark, monkeypatch):
    monkeypatch.setattr(cleaning.F, "xxhash64", lambda *names: F.length("text").cast("long"))
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("cc",)], "text string")
    assert rows(cleaning.drop_copies_of_written(df)) == [("a",), ("b",), ("cc",)]


def test_single_lines_are_not_shuffled_to_be_compared(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    text = cleaning.clean_lines(ws.raw, written=True)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", text)) == 1
    assert text.index("LeftAnti") < text.index("Exchange hashpartitioning") < text.index("LeftSemi")
    ws.drop()


def test_items_are_numbered_by_the_places_of_the_clean_lines(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    assert ranking.PLACE not in ws.clean.columns
    written = len(ws._paths)
    items = ws.order_items
    assert len(ws._paths) == written  # no sequence of its own is sorted and written
    assert rows(items) == rows(entities.fact_order_items(ws.clean))
    ws.drop()


def test_lines_are_sorted_in_bounded_parts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ranking, "_SORTED_ROWS", 500)
    ws = Workspace(spark, sf_dir)
    sizes = [r["count"] for r in ws.placed.groupBy(F.shiftright(ranking.PLACE, 33)).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 2_000
    assert rows(ws.order_items) == rows(entities.fact_order_items(ws.clean))
    ws.drop()
