"""Global numbering and exact quantiles against plain Python and numpy."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.functions.ranking import _PARTS, dense_sequence, exact_quantiles, quantile_name, quantiles_wide
from tillroll.operators.profiling import describe_numeric

PROBABILITIES = (0.0, 0.25, 0.5, 0.9, 0.999, 1.0)


def quantiles_of(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], PROBABILITIES).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.decimals(-10**9, 10**9, places=4), min_size=1, max_size=60))
def test_quantiles_of_decimals(spark, values):
    found = quantiles_of(spark, values, "decimal(18,4)")
    expected = np.quantile([float(v) for v in values], PROBABILITIES)
    assert [found[p] for p in PROBABILITIES] == pytest.approx(list(expected), rel=1e-12, abs=1e-6)


def test_quantiles_with_one_value_on_most_rows(spark):
    rng = random.Random(7)
    values = [0] * 4000 + [rng.randint(-50, 10**6) for _ in range(2000)] + [None] * 10
    found = quantiles_of(spark, values, "int")
    expected = np.quantile([v for v in values if v is not None], PROBABILITIES)
    assert [found[p] for p in PROBABILITIES] == pytest.approx(list(expected))


def test_quantiles_of_close_doubles(spark):
    values = [1e6 + i / 997 for i in range(3000)]
    found = quantiles_of(spark, values, "double")
    assert [found[p] for p in PROBABILITIES] == pytest.approx(list(np.quantile(values, PROBABILITIES)), rel=1e-14)


def test_close_doubles_are_sorted_in_many_parts(spark):
    """200,000 values within one logarithmic bucket: no sorted part holds more than a small share of them."""
    values = [1.7e9 + i / 1000 for i in range(200_000)]
    df = spark.range(0, 200_000, 1, 8).select((F.lit(1.7e9) + F.col("id") / 1000).alias("x"))
    found = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], PROBABILITIES).collect()}
    assert [found[p] for p in PROBABILITIES] == pytest.approx(list(np.quantile(values, PROBABILITIES)), rel=1e-15)
    text = exact_quantiles(df, ["x"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in text and "part#" in text
    low, high = min(values), max(values)
    part = F.floor((F.col("x") - low) / (high - low) * _PARTS)
    assert df.groupBy(part.alias("part")).count().agg(F.max("count")).first()[0] <= 200_000 / 500


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (9, 4)], "x int, n long")
    found = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], [0.5, 0.55, 0.7], weight="n").collect()}
    expected = np.quantile([1] * 5 + [2] + [9] * 4, [0.5, 0.55, 0.7])
    assert [found[p] for p in (0.5, 0.55, 0.7)] == pytest.approx(list(expected))


def test_empty_and_missing_columns(spark):
    df = spark.createDataFrame([(1, None), (3, None)], "x int, y int")
    wide = {r["field"]: r["p50"] for r in quantiles_wide(df, ["x", "y"], [0.5]).collect()}
    assert wide == {"x": 2.0}
    sketch = {r["field"]: r["p50"] for r in quantiles_wide(df, ["x"], [0.5], approx=True).collect()}
    assert sketch["x"] in (1.0, 3.0)


def test_nan_and_infinity(spark):
    values = [float("nan"), float("-inf"), -1.0, None, 2.0, 5.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]).collect()}
    assert found == {0.25: -1.0, 0.5: 2.0, 0.75: 5.0}
    row = describe_numeric(df.filter("abs(x) < 9 or isnan(x)"), ["x"]).first()
    assert (row["count"], row["mean"], row["min"], row["p50"], row["max"]) == (3, 2.0, -1.0, 2.0, 5.0)


def test_quantile_names():
    assert [quantile_name(p) for p in (0.25, 0.5, 0.99, 0.999)] == ["p25", "p50", "p99", "p99_9"]


@pytest.mark.parametrize("partitions", [None, 1, 5, 40])
def test_sequence_is_the_global_rank(spark, partitions):
    rng = random.Random(3)
    data = [(rng.choice("abc"), rng.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, v int, i int").repartition(7)
    order = [F.col("k").asc_nulls_last(), F.col("v").asc_nulls_last(), F.col("i").asc()]
    numbered = dense_sequence(df, order, "id", partitions=partitions)
    found = {r["i"]: r["id"] for r in numbered.collect()}
    ranked = sorted(data, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
    assert found == {row[2]: place for place, row in enumerate(ranked, start=1)}


def test_sequence_spreads_equal_rows(spark):
    """Two thirds of the rows are equal; they still get dense numbers from several partitions."""
    df = spark.range(0, 30000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("v"))
    numbered = dense_sequence(df, [F.col("v").asc()], "id", partitions=6)
    ends = numbered.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(ends) == (1, 30000, 30000)
    tail = numbered.filter("v >= 0").agg(F.min("id")).first()[0]
    assert tail == 20001


def test_sequence_of_nothing(spark):
    empty = spark.createDataFrame([], "v int")
    assert dense_sequence(empty, [F.col("v").asc()], "id").collect() == []
