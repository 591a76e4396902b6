"""Bucketed tables, rejected lines, month sets, stored sketches and brackets of quantiles."""

import dataclasses
import random
import re
import warnings
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.functions import ranking, staging
from tillroll.functions.columns import SOURCE_HEADERS, SOURCE_SCHEMA
from tillroll.functions.staging import new_path
from tillroll.operators import customers, profiling, sketches, views
from tillroll.plans import catalog
from tillroll.plans.workspace import Workspace, workspace
from tillroll.sources import readers, writers


def rows(df):
    return sorted(map(repr, df.collect()))


# --- bucketed tables -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bucketed(spark, sf_dir):
    ws, schema = workspace(spark, sf_dir), "tillroll_buckets"
    writers.bucket_tables(ws.entities, schema, new_path(spark, "buckets"), buckets=8, block_bytes=4096)
    yield {name: spark.table(f"{schema}.{name}") for name in ws.entities}
    spark.sql(f"drop schema {schema} cascade")


def executed(df):
    """The physical plan that ran, after all its stages."""
    df.collect()
    return df._jdf.queryExecution().executedPlan()


def test_items_meet_orders_without_a_shuffle(spark, bucketed, sf_dir):
    ws, before = workspace(spark, sf_dir), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = bucketed["order_items"].join(bucketed["orders"], "invoice")
        plan = executed(joined).toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        plain = executed(ws.order_items.join(ws.orders, "invoice")).toString()
        assert plain.split("Initial Plan")[0].count("Exchange") >= 2
        sold = views.v_sales(bucketed["order_items"], bucketed["orders"], bucketed["products"])
        text = executed(sold).toString().split("Initial Plan")[0]
        assert "SortMergeJoin [invoice" in text and "hashpartitioning(invoice" not in text
        assert rows(sold) == rows(ws.sales)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_buckets_are_several_files(spark, sf_dir, monkeypatch):
    """Tasks that sort and write grow in number with the rows; the join still needs no shuffle."""
    monkeypatch.setattr(writers, "_FILE_ROWS", 250)
    ws, schema, before = workspace(spark, sf_dir), "tillroll_parts", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    path = new_path(spark, "buckets")
    writers.bucket_tables(ws.entities, schema, path, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items, orders = (spark.table(f"{schema}.{name}") for name in ("order_items", "orders"))
        sizes = [r["count"] for r in items.groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) > 8 and max(sizes) < 1_000
        assert "Exchange" not in executed(items.join(orders, "invoice")).toString()
        assert rows(items) == rows(ws.order_items) and rows(orders) == rows(ws.orders)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"drop schema {schema} cascade")


def _scanned(spark, df):
    """Rows that the scan of a table handed on, as its metrics say."""
    plan = executed(df)
    found, open_ = [], [plan]
    while open_:
        node = open_.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            open_.append(node.plan())
        elif "FileSourceScan" in node.getClass().getSimpleName():
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_a_lookup_reads_few_rows(spark, bucketed):
    items = bucketed["order_items"]
    total = items.count()
    code = items.groupBy("stock_code").count().orderBy("count", "stock_code").first()["stock_code"]
    one = items.filter(F.col("stock_code") == code)
    assert 0 < one.count() <= _scanned(spark, one) < total / 5
    invoice = items.first()["invoice"]
    assert _scanned(spark, items.filter(F.col("invoice") == invoice)) <= total / 5, "one bucket of eight, and not all of it"
    assert _scanned(spark, items.filter(F.col("stock_code") == "no such code")) == 0


# --- rejected lines --------------------------------------------------------------------------

HEADER = ",".join(SOURCE_HEADERS)
LINES = [
    '100,A1,"RED, CUP",2,2010-01-05 09:00:00,1.50,1,EIRE',
    "101,A1,CUP,two,2010-01-05 09:00:00,1.50,1,EIRE",
    "102,A1,CUP,2,2010-01-05 09:00:00,1.50,1",
    "103,A1,CUP,2,2010-01-05 09:00:00,1.50,1,EIRE,more",
    "104,A1,,2,some day,cheap,,EIRE",
    '105,A1,"say ""hi""",-2,2010-01-05 09:00:00,.5,,EIRE',
    "106,A1,CUP,3000000000,2010-01-05 09:00:00,1.50,1,EIRE",
    "107,A1,CUP,2.0,2010-01-05 09:00:00,1e1,1,EIRE",
    "108,A1,CUP,2,2010-01-05 09:00:00,123456789012345678,1,EIRE",
]


def test_rejected_lines(spark):
    paths = {}
    for label, held in (("good", LINES[:1] + LINES[5:6]), ("bad", LINES)):
        paths[label] = new_path(spark, "sheet")
        spark.createDataFrame([("\n".join([HEADER, *held]),)], "v string").coalesce(1).write.text(paths[label])
    lines, rejects = readers.scan_union_with_rejects(spark, paths, SOURCE_SCHEMA)
    report = {r[0]: (r[1], r[2]) for r in readers.reject_report(lines, rejects).collect()}
    assert report == {"good": (2, 0), "bad": (2, 7)}
    assert sum(sum(x) for x in report.values()) == len(LINES) + 2, "every line is read or rejected"
    assert lines.columns == [*SOURCE_HEADERS, "source_period"]
    held = {r["Invoice"]: r for r in lines.filter("source_period = 'bad'").collect()}
    assert set(held) == {"100", "105"}
    assert held["100"]["Description"] == "RED, CUP" and held["100"]["Price"] == Decimal("1.5000")
    assert held["105"]["Description"] == 'say "hi"' and held["105"]["Customer ID"] is None
    found = {r["line"][:3]: r for r in rejects.collect()}
    reasons = {invoice: r["reason"] for invoice, r in found.items()}
    assert reasons == {
        "101": "Quantity: two is not int", "102": "fields", "103": "fields",
        "104": "InvoiceDate: some day is not timestamp_ntz; Price: cheap is not decimal(18,4)",
        "106": "Quantity: 3000000000 is not int", "107": "Quantity: 2.0 is not int",
        "108": "Price: 123456789012345678 is not decimal(18,4)",
    }
    assert all(r["source_period"] == "bad" and paths["bad"] in r["file"] and r["block"] == 0 for r in found.values())
    assert found["103"]["line"] == LINES[3]


def test_rejects_of_clean_sheets_and_wrong_headers(spark, raw):
    headed = raw.withColumnsRenamed({name: header for header, name in SOURCE_HEADERS.items()})
    paths = {}
    for label in ("P1", "P2"):
        paths[label] = new_path(spark, "sheet")
        sheet = headed.filter(F.col("source_period") == label).drop("source_period")
        sheet.write.options(**readers.CSV_OPTIONS).csv(paths[label])
    lines, rejects = readers.scan_union_with_rejects(spark, paths, SOURCE_SCHEMA)
    plain = readers.scan_labelled_union(spark, paths, SOURCE_SCHEMA, fmt="csv")
    assert rows(lines) == rows(plain) and rejects.isEmpty()
    wrong = new_path(spark, "sheet")
    headed.drop("source_period").withColumnRenamed("Price", "Prize").write.options(**readers.CSV_OPTIONS).csv(wrong)
    with pytest.raises(Exception, match="header|CSV"):
        readers.scan_union_with_rejects(spark, {"x": wrong}, SOURCE_SCHEMA)
    with pytest.raises(ValueError, match="no sources"):
        readers.scan_union_with_rejects(spark, {}, SOURCE_SCHEMA)


def test_a_required_field(spark):
    path = new_path(spark, "sheet")
    spark.createDataFrame([("1", 2), (None, 3)], "a string, n int").write.options(**readers.CSV_OPTIONS).csv(path)
    schema = spark.createDataFrame([], "a string not null, n int").schema
    found = readers.scan_csv_with_rejects(spark, path, schema).collect()
    assert sorted((r["a"], r["n"], r["_reason"]) for r in found if r["a"]) == [("1", 2, None)]
    assert [r["_reason"] for r in found if not r["a"]] == ["a: missing"]


# --- months as bits --------------------------------------------------------------------------


def _receipts(spark, held):
    df = spark.createDataFrame(held, "customer_id int, day string")
    return views.Receipts(
        df.select("customer_id", F.col("day").cast("timestamp_ntz").alias("invoice_date"),
                  F.monotonically_increasing_id().cast("string").alias("invoice"), F.lit(1).cast("long").alias("quantity"),
                  F.lit(1).cast("decimal(18,4)").alias("revenue"))
    )


def _plain_activity(held):
    months = {}
    for customer, day in held:
        if customer is not None:
            months.setdefault(customer, set()).add(tuple(int(x) for x in day.split("-")[:2]))
    out = []
    for customer, found in months.items():
        a = min(found)
        out += [(customer, a, m, (m[0] - a[0]) * 12 + m[1] - a[1]) for m in found]
    return sorted(out)


def _activity(df):
    part = lambda d: (d.year, d.month)
    return sorted((r[0], part(r[1]), part(r[2]), r[3]) for r in df.collect())


def test_month_sets(spark):
    """Months over more than one word of bits, its last bit included, customers without a number, repeated months."""
    draw = random.Random(4)
    held = [(draw.choice([1, 2, 3, 4, None]), f"{draw.randint(1995, 2012)}-{draw.randint(1, 12):02d}-07") for _ in range(150)]
    held += [(9, f"{1995 + k // 12}-{k % 12 + 1:02d}-28") for k in (0, 63, 64, 127, 128)]
    found = customers.cohort_activity(_receipts(spark, held))
    assert _activity(found) == _plain_activity(held)
    half = [x for i, x in enumerate(held) if i % 2], [x for i, x in enumerate(held) if not i % 2]
    parts = [customers.month_sets(_receipts(spark, x), "1995-01-01", "2012-12-31") for x in half]
    assert _activity(customers.activity_of_sets(customers.merge_month_sets(*parts))) == _plain_activity(held)
    inside = customers.activity_of_sets(customers.month_sets(_receipts(spark, held), "2000-05-01", "2001-04-30"))
    wanted = [(c, d) for c, d in held if "2000-05" <= d < "2001-05"]
    assert _activity(inside) == _plain_activity(wanted)


def test_no_months(spark):
    none = _receipts(spark, [(None, "2010-01-01")])
    assert customers.cohort_activity(none).collect() == []
    assert customers.retention_matrix(customers.cohort_activity(none)).collect() == []
    empty = dataclasses.replace(none, rows=none.rows.limit(0))
    assert customers.cohort_activity(empty).collect() == []


def test_activity_shuffles_one_row_per_customer(spark, sf_dir):
    activity = customers.cohort_activity(workspace(spark, sf_dir).receipts)
    plan = activity._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate [customer_id") == 1
    assert "bit_or" in plan


def test_retention_is_one_map_per_cohort(spark, sf_dir):
    matrix = customers.retention_matrix(customers.cohort_activity(workspace(spark, sf_dir).receipts), range(80))
    plan = matrix._jdf.queryExecution().optimizedPlan().toString()
    assert matrix.columns == ["cohort_month", *[f"month_{k}" for k in range(80)]]
    aggregates = re.findall(r"Aggregate \[cohort_month.*", plan)
    assert len(aggregates) == 2 and all("max(" not in x for x in aggregates)


# --- sketches --------------------------------------------------------------------------------


def test_sketches_are_exact_for_few_and_near_for_many(spark):
    many = [(i % 30_000, f"2010-{1 + i % 6:02d}-01") for i in range(60_000)]
    rc = _receipts(spark, many)
    exact = sketches.range_metrics(sketches.month_sketches(rc)).first()
    assert (exact["customers"], exact["invoices"], exact["revenue"]) == (30_000, 60_000, Decimal("60000.00"))
    rough = sketches.range_metrics(sketches.month_sketches(rc, precision=10), precision=10).first()
    for name, true in (("customers", 30_000), ("invoices", 60_000)):
        assert rough[name] != true
        assert abs(rough[name] / true - 1) < 4 * sketches.sketch_error(10)


def test_months_merge_to_ranges_and_loads(spark):
    held = [(c, f"2010-{m:02d}-05") for c in range(40) for m in range(1, 13) if c % m == 0]
    whole = sketches.month_sketches(_receipts(spark, held))
    parts = [sketches.month_sketches(_receipts(spark, [x for i, x in enumerate(held) if i % 2 == k])) for k in (0, 1)]
    merged = sketches.merge_sketches(*parts)
    for first, last in ((1, 3), (4, 4), (2, 12)):
        bounds = f"2010-{first:02d}-01", f"2010-{last:02d}-01"
        true = len({c for c, day in held if first <= int(day[5:7]) <= last})
        assert sketches.range_metrics(whole, *bounds).first()["customers"] == true
        assert sketches.range_metrics(merged, *bounds).first()["customers"] == true
    both = sketches.returning_customers(whole, ("2010-02-01", "2010-02-01"), ("2010-03-01", "2010-05-01")).first()
    later = {c for c, day in held if 3 <= int(day[5:7]) <= 5}
    assert tuple(both) == (20, len(later), len(later & {c for c in range(0, 40, 2)}))
    quarters = sketches.period_metrics(merged).collect()
    assert [r["period"].month for r in quarters] == [1, 4, 7, 10]
    nothing = sketches.range_metrics(whole, "2011-01-01").first()
    assert nothing["first_month"] is None and nothing["revenue"] is None


# --- quantiles in brackets -------------------------------------------------------------------


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    """A sketch far too small for its stated error: the ranks are found all the same."""
    monkeypatch.setattr(ranking, "_SKETCH_ITEMS", 8)
    monkeypatch.setattr(ranking, "_RANK_ERROR", 1e-6)
    made = []
    slotted = ranking._slotted
    monkeypatch.setattr(ranking, "_slotted", lambda *args: made.append(args) or slotted(*args))
    real = ranking.sketch_brackets
    monkeypatch.setattr(
        ranking, "sketch_brackets", lambda df, x, p, *more, error=1e-6: real(df, x, p, *more, error=error, items=8)
    )
    df = spark.range(0, 50_000, 1, 4).select((F.hash("id") / 7.0).alias("x"), (F.col("id") % 3).alias("y"))
    found = {(r["field"], r["p"]): r["value"] for r in ranking.exact_quantiles(df, ["x", "y"], [0.1, 0.5, 0.99]).collect()}
    assert len(made) > 1, "the first brackets missed"
    for name in ("x", "y"):
        values = [r[0] for r in df.select(name).collect()]
        want = np.quantile(np.array(values, float), [0.1, 0.5, 0.99])
        assert [found[name, p] for p in (0.1, 0.5, 0.99)] == pytest.approx(list(want), rel=1e-12)


def test_quantiles_read_the_rows_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(0, 30_000, 1, 4).select((F.hash("id") % 1000).alias("x"), F.col("id").alias("y"))
    df = df.mapInArrow(run, df.schema)
    described = profiling.describe_numeric(df, ["x", "y"])
    assert [r["count"] for r in described.collect()] == [30_000, 30_000]
    assert seen.value == 60_000


@pytest.mark.parametrize("n", [1, 2, 3, 5, 50, 101, 4000, 5000])
def test_quantiles_of_any_number_of_rows(spark, n):
    draw = random.Random(n)
    values = [draw.choice([draw.gauss(0, 1), 0.0, float(draw.randint(0, 9))]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    ps = [0.0, 0.001, 0.25, 0.5, 0.95, 0.999, 1.0]
    found = {r["p"]: r["value"] for r in ranking.exact_quantiles(df, ["x"], ps).collect()}
    assert [found[p] for p in ps] == pytest.approx(list(np.quantile(values, ps)), rel=1e-12, abs=1e-12)


def test_invoice_receipts_are_made_of_v_sales_alone(spark, clean, tables, sales_view):
    by_hand = tables["order_items"].join(clean.select("invoice", "customer_id", "invoice_date", "country"), "invoice")
    for lines in (clean, by_hand):
        with pytest.raises(ValueError, match="v_sales"):
            views.invoice_receipts(lines)
    path = new_path(spark, "sold")
    sales_view.filter("quantity > 1").write.parquet(path)
    for lines in (staging.stage(sales_view, "sold"), spark.read.parquet(path)):
        assert views.invoice_receipts(lines).by_invoice


# --- stages ----------------------------------------------------------------------------------


def test_a_stage_that_cannot_be_deleted_hides_no_result(spark, monkeypatch):
    def refused(spark, path):
        raise OSError("read only\nfor now")

    monkeypatch.setattr(staging, "delete_folder", refused)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        with staging.owned_stages(spark) as paths:
            n = staging.stage(spark.range(3).toDF("v"), "probe").count()
    assert n == 3 and len(paths) == 1
    assert [str(w.message) for w in told if "left behind" in str(w.message)] == [f"stage {paths[0]} is left behind: read only"]


def test_folders_of_any_file_system(spark):
    """Paths go through Spark's own file systems, such as one that only Hadoop knows."""
    base = new_path(spark, "folders")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.tillroll.link./in", f"file://{base}")
    spark.range(3).write.parquet(f"{base}/a")
    assert staging.folder_names(spark, "viewfs://tillroll/in") == ["a"]
    staging.move_folder(spark, "viewfs://tillroll/in/a", "viewfs://tillroll/in/b/c")
    assert staging.folder_exists(spark, f"{base}/b/c") and not staging.folder_exists(spark, f"{base}/a")
    with pytest.raises(FileExistsError):
        staging.move_folder(spark, "viewfs://tillroll/in/b", "viewfs://tillroll/in/b/c")
    assert staging.delete_folder(spark, "viewfs://tillroll/in/b")
    assert not staging.delete_folder(spark, "viewfs://tillroll/in/b")
    assert Counter(staging.folder_names(spark, base)) == Counter()


def test_a_dropped_workspace_leaves_nothing(spark, sf_dir):
    """Stages, published folders and sheets that queries wrote go with the workspace they ran in."""
    folder = f"{staging.shared_folder(spark)}/tillroll/{spark.sparkContext.applicationId}"
    before = set(staging.folder_names(spark, folder))
    ws = Workspace(spark, sf_dir)
    for name in ("quantile_table", "publish_version", "append_lines", "reject_report", "layout_tables", "retention_matrix"):
        assert ws.run(catalog.query_named(name)).count() > 0
    assert len(set(staging.folder_names(spark, folder)) - before) > 10
    ws.drop()
    assert set(staging.folder_names(spark, folder)) == before
