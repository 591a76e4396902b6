"""Files written and read back, with the values that break careless CSV."""

import datetime
import os
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from tillroll.functions.columns import ENTITY_SCHEMAS, LOAD_ORDER, SOURCE_HEADERS, SOURCE_SCHEMA
from tillroll.functions.staging import new_path, shared_folder, stage
from tillroll.operators import checks, views
from tillroll.plans.workspace import Workspace, workspace
from tillroll.sources import readers, writers

AT = datetime.datetime(2010, 1, 5, 9, 0)
ODD = [
    ("1", "A,1", 'say "hi"', 1, AT, Decimal("1.5000"), 7, "EIRE"),
    ("2", " A2 ", "", -2, AT.replace(microsecond=250000), Decimal("0.0000"), None, "Côte d'Ivoire"),
    ("3", "A\\3", None, 0, AT, Decimal("-1.2500"), 9, " "),
    ("C4", "#1", "'", 3, AT, Decimal("99999999999999.9999"), 1, "x"),
]


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_labelled_union(spark, fmt):
    sheet = spark.createDataFrame(ODD, SOURCE_SCHEMA)
    paths = {label: new_path(spark, "sheet") for label in ("2009-2010", "2010-2011")}
    for path in paths.values():
        options = readers.CSV_OPTIONS if fmt == "csv" else {}
        sheet.write.options(**options).format(fmt).save(path)
    lines = readers.rename_columns(readers.scan_labelled_union(spark, paths, SOURCE_SCHEMA, fmt=fmt))
    assert lines.columns == [*SOURCE_HEADERS.values(), "source_period"]
    assert lines.groupBy("source_period").count().count() == 2
    assert same(lines.filter("source_period = '2009-2010'").drop("source_period"),
                readers.rename_columns(sheet))


def test_no_sources(spark):
    with pytest.raises(ValueError, match="no sources"):
        readers.scan_labelled_union(spark, {}, SOURCE_SCHEMA)


def test_line_breaks_inside_text(spark):
    sheet = spark.createDataFrame([(ODD[0][:2] + ("two\nlines",) + ODD[0][3:])], SOURCE_SCHEMA)
    path = new_path(spark, "sheet")
    sheet.write.options(**readers.CSV_OPTIONS).csv(path)
    assert same(readers.scan_typed_csv(spark, path, SOURCE_SCHEMA, multi_line=True), sheet)


def test_union_of_sheets_with_line_breaks(spark):
    odd = [ODD[0][:2] + ('two\nlines, a "quote"',) + ODD[0][3:], ODD[1][:2] + ("",) + ODD[1][3:]]
    sheet = spark.createDataFrame(odd, SOURCE_SCHEMA)
    paths = writers.sink_csv({"a": sheet, "b": sheet}, new_path(spark, "sheets"))
    lines = readers.scan_labelled_union(spark, paths, SOURCE_SCHEMA, fmt="csv", multi_line=True)
    assert same(lines.filter("source_period = 'b'").drop("source_period"), sheet)


def test_wrong_header_and_wrong_value_fail(spark):
    path = new_path(spark, "bad")
    spark.createDataFrame([("x", "text")], "invoice string, qty string").write.options(**readers.CSV_OPTIONS).csv(path)
    with pytest.raises(Exception, match="MALFORMED|header|FAILED_READ"):
        readers.scan_typed_csv(spark, path, spark.createDataFrame([], "invoice string, quantity int").schema).collect()
    with pytest.raises(Exception, match="MALFORMED|header|FAILED_READ"):
        readers.scan_typed_csv(spark, path, spark.createDataFrame([], "invoice string, qty int").schema).collect()


def test_entities_round_trip(spark, tables):
    paths = writers.sink_csv_tables(tables, new_path(spark, "csv"))
    assert list(paths) == list(LOAD_ORDER)
    for name in LOAD_ORDER:
        assert same(readers.scan_typed_csv(spark, paths[name], ENTITY_SCHEMAS[name]), tables[name])


def test_stage_round_trip(spark, clean):
    path = writers.sink_stage(clean, new_path(spark, "stage"))
    assert same(readers.scan_stage(spark, path), clean)
    assert same(readers.scan_stage(spark, path, clean.schema), clean)
    with pytest.raises(PySparkException):
        writers.sink_stage(clean, path)


def test_publish(spark, tables):
    counts = writers.publish_tables(tables, new_path(spark, "published"))
    assert [tuple(r) for r in counts.orderBy("load_order").collect()] == [
        (1, "customers", 4), (2, "products", 7), (3, "orders", 11), (4, "order_items", 15)
    ]


def test_publish_writes_nothing_when_a_check_fails(spark, tables):
    folder = new_path(spark, "refused")
    with pytest.raises(checks.ConstraintError):
        writers.publish_tables({**tables, "customers": tables["customers"].limit(1)}, folder)
    with pytest.raises(PySparkException):
        spark.read.parquet(f"{folder}/customers").count()


def test_layout_prunes_by_month_and_country(spark, clean):
    path = writers.layout_tables(clean, new_path(spark, "layout"))
    back = spark.read.parquet(path)
    assert same(back.select(*clean.columns), clean)
    march = back.filter("order_month = date '2010-03-01' and country = 'EIRE'")
    plan = march._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan
    assert "EqualTo(country,EIRE)" in plan
    assert march.count() == 1


def test_sql_over_registered_views(spark, tables):
    names = views.register_tables(tables, prefix="t_") + views.register_views(tables, prefix="t_")
    assert names[-1] == "t_v_monthly_metrics"
    found = spark.sql(
        "select count(*) filter (where customer_id is null) as unknown, round(sum(s.line_total), 2) as revenue,"
        " count(distinct i.stock_code) as codes from t_v_sales s join t_order_items i using (order_item_id)"
    ).first()
    assert tuple(found) == (1, Decimal("1110.50"), 4)


def test_stage_uses_the_shared_folder(spark):
    staged = stage(spark.range(3).toDF("v"), "probe")
    assert all(shared_folder(spark) in path for path in staged.inputFiles())


def test_workspace_is_shared_and_made_once(spark, sf_dir):
    first, second = workspace(spark, sf_dir), workspace(spark, sf_dir + "/")
    assert first is second
    assert first.receipts is second.receipts


def test_published_catalog(spark, tables):
    names = writers.publish_catalog(tables, "tillroll_test", new_path(spark, "catalog"))
    assert {n.split(".")[1]: spark.table(n).count() for n in names} == {
        "customers": 4, "products": 7, "orders": 11, "order_items": 15, "v_sales": 11, "v_customer_sales": 10,
        "v_invoice_summary": 8, "v_monthly_metrics": 4,
    }
    spark.sql("drop schema tillroll_test cascade")


def test_a_workspace_can_be_dropped(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    path = ws.raw.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    ws.drop()
    assert not os.path.exists(path)
    assert ws.raw.count() > 0
    ws.drop()


def test_statistics_of_a_catalog_table(spark, clean):
    clean.write.option("path", new_path(spark, "catalog")).saveAsTable("tillroll_lines")
    writers.analyze_table(spark, "tillroll_lines")
    details = {r["col_name"]: r["data_type"] for r in spark.sql("describe extended tillroll_lines").collect()}
    assert "15 rows" in details["Statistics"]
    spark.sql("drop table tillroll_lines")
