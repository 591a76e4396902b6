"""Shapes of the physical plans that decide how the queries scale."""

import re

import pytest
from pyspark.sql import functions as F

from tillroll.operators import checks, cleaning, customers, entities, profiling, sales, views
from tillroll.plans import catalog
from tillroll.plans.workspace import Workspace, workspace
from tillroll.sources import writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ws(spark, sf_dir):
    return workspace(spark, sf_dir)


def test_top_k_does_not_sort_everything(ws):
    order = [F.col("invoice").asc_nulls_last()]
    top = profiling.top_n_rows(ws.line_sales, "line_total", 15, ["invoice", "line_total"], order)
    assert "TakeOrderedAndProject" in plan(top)
    assert "TakeOrderedAndProject" in plan(profiling.value_counts(ws.raw, "description", 20))


def test_filters_and_columns_reach_the_scan(ws):
    text = plan(cleaning.filter_sales(ws.clean).agg(F.sum("line_total")))
    assert "GreaterThan(quantity,0)" in text
    assert "description" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_sales_view_joins_by_key(ws):
    text = plan(views.v_sales(ws.order_items, ws.orders, ws.products))
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert "GreaterThan(quantity,0)" in text


def test_invoice_metrics_need_no_expand(ws):
    for frame in (
        views.v_monthly_metrics(ws.receipts),
        sales.country_summary(ws.receipts),
        sales.core_metrics(ws.sales, ws.receipts),
        customers.rfm_customer(ws.receipts),
        profiling.profile_main_info(ws.raw),
        profiling.distinct_counts(ws.raw),
    ):
        assert "Expand" not in plan(frame)


def test_row_level_steps_have_no_single_partition_window(ws):
    for frame in (
        entities.dim_products(ws.clean), entities.fact_orders(ws.clean), views.receipts(ws.sales).rows,
        customers.cohort_activity(ws.receipts), cleaning.drop_exact_duplicates(ws.raw),
        profiling.duplicate_rows(ws.raw, None), checks.check_fk_items_orders(ws.order_items, ws.orders),
    ):
        text = plan(frame)
        assert "Window" not in text
        assert "CartesianProduct" not in text


def test_duplicates_are_folded_before_the_shuffle(ws):
    text = plan(cleaning.drop_exact_duplicates(ws.raw))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def operators(frame):
    """Names of the physical operators from the scan upwards, along the longest branch."""
    lines = [line for line in plan(frame).split("\n") if re.search(r"[A-Za-z]", line) and "AdaptiveSparkPlan" not in line]
    return [re.sub(r"^[\s:+*()\d-]*", "", line).split(" ")[0] for line in lines][::-1]


def test_no_sort_below_the_first_aggregate(ws):
    sources = {"source_period": ["P1", "P2"]}
    for frame in (
        entities.fact_orders(ws.clean),
        cleaning.drop_exact_duplicates(ws.raw, ignore=["source_period"], values=sources),
        customers.cohort_activity(ws.receipts),
    ):
        names = operators(frame)
        first = next(i for i, name in enumerate(names) if "Aggregate" in name)
        assert names[first].startswith("HashAggregate") and "Sort" not in names[:first], names
    assert "Aggregate" not in plan(views.v_invoice_summary(ws.receipts))
    assert "SortAggregate" not in plan(cleaning.drop_exact_duplicates(ws.raw, ignore=["source_period"], values=sources))


def test_no_python_in_the_plans(ws):
    for frame in (ws.line_receipts.rows, customers.rfm_segments(customers.rfm_scores(ws.rfm))):
        assert "Python" not in plan(frame) and "Pandas" not in plan(frame)


def shuffled_joins(spark, build):
    """Keys of the joins of a frame, the last one first, as they are planned for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return re.findall(r"SortMergeJoin \[(\w+)#", plan(build()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_receipts_join_only_their_columns(spark, sf_dir):
    """Receipts alone write no sales lines with texts and keys; they are those of the sales lines all the same."""
    own = Workspace(spark, sf_dir)
    try:
        rows = own.receipts.rows
        assert "sales" not in own._tables
        wide = views.invoice_receipts(own.sales).rows
        assert rows.count() > 0 and rows.exceptAll(wide).isEmpty() and wide.exceptAll(rows).isEmpty()
        assert shuffled_joins(spark, own._v_sales) == ["invoice", "stock_code"]
    finally:
        own.drop()


def test_orders_last_changes_no_line(ws):
    lines = [views.v_sales(ws.order_items, ws.orders, ws.products, orders_last=last) for last in (False, True)]
    assert lines[0].schema == lines[1].schema
    assert lines[0].exceptAll(lines[1]).isEmpty() and lines[1].exceptAll(lines[0]).isEmpty()


def test_view_of_months_shuffles_lines_twice(spark, ws):
    """To their products and to their orders, by whose shuffle they fold to receipts."""
    views.register_tables(ws.entities, prefix="months_")
    texts = {name: text.replace("s.", "months_") for name, text in writers.view_texts("s", ["M"]).items()}
    text = texts["v_monthly_metrics"].replace("months_v_sales", f"({texts['v_sales']})")
    assert shuffled_joins(spark, lambda: spark.sql(text)) == ["invoice", "stock_code"]


def test_exported_orders_meet_customers_before_lines(spark, ws):
    found = shuffled_joins(spark, lambda: catalog.query_named("sink_csv_tables")(ws))
    assert found[0] == "invoice" and sorted(found[1:]) == ["customer_id", "stock_code"]
