"""The whole flow on the hand-written lines, and where its stages are kept."""

import os
from types import SimpleNamespace

import pytest

from tillroll.functions.columns import SOURCE_HEADERS
from tillroll.functions.staging import new_path, shared_folder
from tillroll.plans.flow import run_flow
from tillroll.sources import readers


def test_flow(spark, raw):
    sheets = {}
    headed = raw.withColumnsRenamed({name: header for header, name in SOURCE_HEADERS.items()})
    for label in ("P1", "P2"):
        sheets[label] = new_path(spark, "sheet")
        sheet = headed.filter(f"source_period = '{label}'").drop("source_period")
        sheet.write.options(**readers.CSV_OPTIONS).csv(sheets[label])
    folder = new_path(spark, "flow")
    stages = f"{shared_folder(spark)}/tillroll/{spark.sparkContext.applicationId}"
    before = set(os.listdir(stages))
    out = run_flow(spark, sheets, folder, fmt="csv", view_prefix="flow_")
    assert {r["table_name"]: r["rows_count"] for r in out["table_counts"].collect()} == {
        "customers": 4, "products": 7, "orders": 11, "order_items": 15
    }
    assert out["monthly_sales"].count() == 4
    assert spark.table("flow_v_sales").count() == out["sales"].count() == 11
    assert spark.read.option("header", True).csv(f"{folder}/summaries/country_summary").count() == 3
    total = spark.sql("select sum(revenue) from flow_v_monthly_metrics").first()[0]
    assert float(total) == 1110.5
    left = set(os.listdir(stages)) - before
    assert left == {os.path.basename(folder)}, "only what the flow publishes is left"
    assert set(os.listdir(folder)) == {"raw", "clean", "tables", "summaries"}


def session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn"))
    assert shared_folder(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.warns(UserWarning, match="spark.checkpoint.dir is not set"):
        first = shared_folder(session("local[2]"))
    assert shared_folder(session("local[2]")) == first
