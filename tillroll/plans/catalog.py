"""Every operator as a query over a workspace, under the name it is checked by."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import ENTITY_SCHEMAS, LOAD_ORDER, RETAIL, SOURCE_HEADERS, SOURCE_SCHEMA
from tillroll.functions.staging import stage
from tillroll.operators import (
    checks, cleaning, consistency, customers, entities, profiling, sales, sketches, views,
)
from tillroll.plans.workspace import Workspace, workspace
from tillroll.sources import increments, readers, versions, writers

HOME = "NATION_0"
FIRST_COHORT, LAST_COHORT = "1995-02-01", "1999-12-01"
YEARS = (1996, 1997)
VARIANT_CODE = "10"

NUMBERS = ["quantity", "price", "line_total"]

Query = Callable[[Workspace], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def comparable(df: DataFrame, **digits: int) -> DataFrame:
    """Decimals as doubles, and doubles rounded where another engine may differ in the last bit."""
    columns = []
    for field in df.schema:
        col = F.col(f"`{field.name}`")
        if field.name in digits:
            col = F.round(col.cast("decimal(38,10)"), digits[field.name]).cast("double")
        elif isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        columns.append(col.alias(field.name))
    return df.select(*columns)


def _row_order(names=RETAIL.raw) -> list:
    return [F.col(name).asc_nulls_last() for name in names]


def _described(df: DataFrame) -> DataFrame:
    exact = {name: 6 for name in df.columns if name not in ("field", "count", "std")}
    return comparable(df, std=2, **exact)


# --- sources and sinks ---------------------------------------------------------------------


def _write_sheets(ws: Workspace, fmt: str) -> dict[str, str]:
    """The raw lines as one source per label, under the headers of the source sheets."""
    headed = ws.raw.withColumnsRenamed({name: header for header, name in SOURCE_HEADERS.items()})
    paths = {}
    for label in ("P1", "P2"):
        paths[label] = ws.new_path(f"sheet-{label}")
        sheet = headed.filter(F.col("source_period") == label).drop("source_period")
        options = readers.CSV_OPTIONS if fmt == "csv" else {}
        sheet.write.options(**options).format(fmt).save(paths[label])
    return paths


@query
def scan_labelled_union(ws):
    sheets = _write_sheets(ws, "csv")
    lines = readers.scan_labelled_union(ws.spark, sheets, SOURCE_SCHEMA, fmt="csv")
    return readers.rename_columns(lines)


@query
def scan_labelled_union_parquet(ws):
    sheets = _write_sheets(ws, "parquet")
    return readers.rename_columns(readers.scan_labelled_union(ws.spark, sheets, SOURCE_SCHEMA))


@query
def rename_columns(ws):
    return readers.rename_columns(ws.raw, {"invoice": "Invoice", "customer_id": "Customer ID"})


@query
def sink_stage(ws):
    path = writers.sink_stage(ws.clean, ws.new_path("stage"))
    return readers.scan_stage(ws.spark, path)


@query
def scan_stage(ws):
    path = writers.sink_stage(ws.raw, ws.new_path("stage"))
    wanted = T.StructType([f for f in ws.raw.schema if f.name in ("invoice", "quantity", "customer_id")])
    return readers.scan_stage(ws.spark, path, wanted)


@query
def scan_typed_csv(ws):
    paths = writers.sink_csv({"orders": ws.orders}, ws.new_path("csv"))
    return readers.scan_typed_csv(ws.spark, paths["orders"], ENTITY_SCHEMAS["orders"])


@query
def sink_csv_tables(ws):
    paths = writers.sink_csv_tables(ws.entities, ws.new_path("csv"))
    back = {name: readers.scan_typed_csv(ws.spark, paths[name], ENTITY_SCHEMAS[name]) for name in LOAD_ORDER}
    # Orders meet their customers before they meet the lines, which are far more.
    known = back["customers"].withColumn("known", F.lit(True))
    headers = back["orders"].drop("is_cancelled").join(known, "customer_id", "left")
    named = back["order_items"].join(back["products"], "stock_code").join(headers, "invoice")
    return named.select(
        "customer_id", "stock_code", "invoice", "order_item_id", "quantity", "price", "line_total",
        "invoice_date", "country", "description", "known",
    )


@query
def sink_csv_summaries(ws):
    sold, rc = ws.sales, ws.receipts  # sales first, so that receipts are made of them
    frames = {
        "monthly_sales": sales.monthly_metrics(rc),
        "rfm_segments": customers.rfm_segment_summary(_segments(ws)),
        "country_summary": sales.country_summary(rc),
        "product_summary": sales.product_summary(sold, ws.products),
    }
    paths = writers.sink_csv_summaries(*frames.values(), ws.new_path("csv"))
    label = {"monthly_sales": "month", "rfm_segments": "segment", "country_summary": "country",
             "product_summary": "stock_code"}
    reports = [
        readers.scan_typed_csv(ws.spark, paths[name], frame.schema).select(
            F.lit(name).alias("report"), F.col(label[name]).cast("string").alias("label"), "revenue"
        )
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, reports)


@query
def publish_tables(ws):
    return writers.publish_tables(ws.entities, ws.new_path("published"))


@query
def publish_catalog(ws):
    """Rows of the named tables and of the views over them, read back by name."""
    path = ws.new_path("catalog")
    names = writers.publish_catalog(ws.entities, f"tillroll_{path[-12:]}", path)
    parts = [f"select '{name.split('.')[1]}' as name, count(*) as rows from {name}" for name in names]
    return ws.spark.sql(" union all ".join(parts))


@query
def publish_catalog_metrics(ws):
    """A view that builds on another one, over named tables."""
    path = ws.new_path("catalog")
    writers.publish_catalog(ws.entities, f"tillroll_{path[-12:]}", path)
    return comparable(ws.spark.table(f"tillroll_{path[-12:]}.v_monthly_metrics"))


@query
def register_views(ws):
    names = views.register_views(ws.entities, prefix="tillroll_")
    parts = [f"select '{name.removeprefix('tillroll_')}' as view_name, count(*) as rows from {name}" for name in names]
    return ws.spark.sql(" union all ".join(parts))


@query
def register_tables(ws):
    views.register_tables(ws.entities, prefix="tillroll_")
    return ws.spark.sql(
        "select o.is_cancelled, count(*) as rows, count(distinct o.invoice) as invoices,"
        " sum(i.line_total) as total from tillroll_order_items i"
        " join tillroll_orders o on o.invoice = i.invoice group by o.is_cancelled"
    )


@query
def layout_tables(ws):
    path = writers.layout_tables(ws.clean, ws.new_path("layout"))
    return ws.spark.read.parquet(path).select(*ws.clean.columns)


@query
def layout_tables_pruned(ws):
    path = writers.layout_tables(ws.clean, ws.new_path("layout"))
    year = ws.spark.read.parquet(path).filter(
        (F.col("order_month") >= F.lit("1996-01-01").cast("date"))
        & (F.col("order_month") < F.lit("1997-01-01").cast("date"))
        & (F.col("country") == HOME)
    )
    return year.groupBy("order_month").agg(F.count("*").alias("rows"), F.sum("line_total").alias("total"))


@query
def bucket_tables(ws):
    """Sales lines over tables whose items and orders meet bucket by bucket."""
    path = ws.new_path("buckets")
    schema = f"tillroll_{path[-12:]}"
    writers.bucket_tables(ws.entities, schema, path, buckets=8)
    held = [ws.spark.table(f"{schema}.{name}") for name in ("order_items", "orders", "products")]
    return comparable(views.v_sales(*held))


@query
def bucket_tables_lookup(ws):
    """Lines of one product and receipts of one customer, looked up in bucketed tables."""
    path = ws.new_path("buckets")
    schema = f"tillroll_{path[-12:]}"
    writers.bucket_tables(ws.entities, schema, path, buckets=8)
    items = ws.spark.table(f"{schema}.order_items").filter(F.col("stock_code") == VARIANT_CODE)
    orders = ws.spark.table(f"{schema}.orders").join(items.select("invoice").distinct(), "invoice")
    return orders.groupBy("country", "is_cancelled").agg(F.count("*").alias("orders"))


def _by_period(ws: Workspace) -> tuple[DataFrame, DataFrame]:
    return tuple(ws.clean.filter(F.col("source_period") == label) for label in ("P1", "P2"))


@query
def publish_version(ws):
    """Rows of the tables that readers find after a publication, a load that breaks a rule, and another publication."""
    folder = ws.new_path("versions")
    versions.publish_version(entities.normalise(_by_period(ws)[0], staged=True), folder)
    try:
        versions.publish_version({**ws.entities, "customers": ws.customers.limit(1)}, folder)
        raise AssertionError("a customer is missing, yet the load was published")
    except checks.ConstraintError:
        versions.publish_version(ws.entities, folder)
    return checks.table_row_counts(versions.published(ws.spark, folder))


@query
def publish_version_former(ws):
    """Order headers of the former publication, by its name."""
    folder = ws.new_path("versions")
    former = versions.publish_version(entities.normalise(_by_period(ws)[0], staged=True), folder)
    versions.publish_version(ws.entities, folder)
    return versions.published(ws.spark, folder, former)["orders"]


@query
def publish_views(ws):
    """The monthly view of a catalog that was made over one publication and turned to the next."""
    path = ws.new_path("versions")
    schema = f"tillroll_{path[-12:]}"
    versions.publish_version(entities.normalise(_by_period(ws)[0], staged=True), path)
    versions.publish_views(ws.spark, path, schema)
    versions.publish_version(ws.entities, path)
    versions.refresh_views(ws.spark, schema)
    return comparable(ws.spark.table(f"{schema}.v_monthly_metrics"))


def _appended(ws: Workspace) -> dict[str, DataFrame]:
    """The tables after both sources were loaded one after the other, the second one twice."""

    def build():
        folder = ws.new_path("appended")
        first, second = _by_period(ws)
        for lines in (first, second, second):
            increments.append_lines(ws.spark, folder, lines)
        return increments.entities_of(ws.spark, folder)

    return ws.made("appended", build)


@query
def append_lines(ws):
    """Order items of two loads: the keys of the first stay, the second continues them."""
    return comparable(_appended(ws)["order_items"])


@query
def append_lines_parents(ws):
    """Sales by country and description over appended tables, whose headers and products come from the counts of all loads."""
    held = _appended(ws)
    sold = views.v_sales(held["order_items"], held["orders"], held["products"])
    return comparable(
        sold.groupBy("country", "description").agg(F.count("*").alias("lines"), F.sum("line_total").alias("total"))
    )


@query
def append_lines_unlabelled(ws):
    """Loads whose lines count as copies whatever source they came from."""
    folder = ws.new_path("appended")
    for lines in _by_period(ws):
        increments.append_lines(ws.spark, folder, lines, ignore_source=True)
    items = increments.entities_of(ws.spark, folder)["order_items"]
    return items.agg(F.count("*").alias("items"), F.max("order_item_id").alias("last_key"))


def _dirty_sheets(ws: Workspace) -> dict[str, str]:
    """CSV sheets in which some quantities and prices are words."""
    headed = ws.raw.withColumnsRenamed({name: header for header, name in SOURCE_HEADERS.items()})
    number = F.regexp_extract("Invoice", "[0-9]+", 0).cast("long")
    texts = headed.withColumns(
        {
            "Quantity": F.when(number % 101 == 0, F.concat(F.lit("q"), "Quantity")).otherwise(F.col("Quantity").cast("string")),
            "Price": F.when(number % 103 == 0, F.lit("free")).otherwise(F.col("Price").cast("string")),
        }
    )
    paths = {}
    for label in ("P1", "P2"):
        paths[label] = ws.new_path(f"sheet-{label}")
        sheet = texts.filter(F.col("source_period") == label).drop("source_period")
        sheet.write.options(**readers.CSV_OPTIONS).csv(paths[label])
    return paths


@query
def scan_union_with_rejects(ws):
    """The readable lines of sheets with words among the numbers."""
    lines, _ = readers.scan_union_with_rejects(ws.spark, _dirty_sheets(ws), SOURCE_SCHEMA)
    return comparable(readers.rename_columns(lines))


@query
def reject_report(ws):
    """Lines read and rejected per source, and why."""
    lines, rejects = readers.scan_union_with_rejects(ws.spark, _dirty_sheets(ws), SOURCE_SCHEMA)
    why = rejects.groupBy("source_period").agg(
        F.count_if(F.col("reason").contains("Quantity: q")).alias("bad_quantities"),
        F.count_if(F.col("reason").contains("Price: free is not decimal(18,4)")).alias("bad_prices"),
    )
    return readers.reject_report(lines, rejects).join(why, "source_period", "left")


@query
def month_sketches(ws):
    """Quarters from stored months; months of two loads are merged first."""
    early = F.col("invoice_date") < F.lit("1998-04-15").cast("timestamp_ntz")
    parts = [
        sketches.month_sketches(dataclasses.replace(ws.receipts, rows=ws.receipts.rows.filter(part)))
        for part in (early, ~early)
    ]
    return comparable(sketches.period_metrics(sketches.merge_sketches(*parts)))


@query
def range_metrics(ws):
    """One range of months from stored sketches."""
    return comparable(sketches.range_metrics(sketches.month_sketches(ws.receipts), "1996-03-01", "1998-11-01"))


@query
def returning_customers(ws):
    """Customers of one year who are back in another, from stored sketches."""
    spans = [(f"{year}-01-01", f"{year}-12-01") for year in YEARS]
    return sketches.returning_customers(sketches.month_sketches(ws.receipts), *spans)


# --- cleaning ------------------------------------------------------------------------------


@query
def cast_types(ws):
    """Raw lines as a sheet reader leaves them: a floating customer id, a text for the time."""
    untyped = ws.raw.withColumns(
        {"customer_id": F.col("customer_id").cast("double"), "invoice_date": F.col("invoice_date").cast("string")}
    )
    return cleaning.cast_types(untyped).select("invoice", "stock_code", "customer_id", "invoice_date")


@query
def cast_rejects(ws):
    """Values lost if codes and prices were whole numbers: service codes and fractions."""
    whole = {name: T.IntegerType() for name in ("invoice", "stock_code", "price", "customer_id")}
    return cleaning.cast_rejects(ws.raw, whole)


@query
def trim_strings(ws):
    return cleaning.trim_strings(ws.raw)


@query
def drop_exact_duplicates(ws):
    return cleaning.drop_exact_duplicates(ws.raw)


@query
def drop_exact_duplicates_unlabelled(ws):
    return cleaning.drop_exact_duplicates(ws.raw, ignore=["source_period"], values={"source_period": ["P1", "P2"]})


@query
def duplicates_removed(ws):
    return cleaning.duplicates_removed(cleaning.trim_strings(ws.raw))


@query
def flag_cancelled(ws):
    return cleaning.flag_cancelled(ws.raw.select("invoice", "quantity"))


@query
def flag_cancelled_any_case(ws):
    return cleaning.flag_cancelled(ws.raw.select("invoice", "quantity"), case_insensitive=True)


@query
def flag_negative_quantity(ws):
    return cleaning.flag_negative_quantity(ws.raw.select("invoice", "quantity"))


@query
def flag_service(ws):
    return cleaning.flag_service(ws.raw.select("invoice", "stock_code"))


@query
def flag_service_by_table(ws):
    """Service codes taken from a table: the goods that were never sold at a price."""
    unpriced = ws.raw.groupBy("stock_code").agg(F.max("price").alias("p")).filter("p <= 0").select("stock_code")
    return cleaning.flag_service(ws.raw.select("invoice", "stock_code"), unpriced)


@query
def derive_line_total(ws):
    return comparable(cleaning.derive_line_total(ws.raw.select("invoice", "quantity", "price")))


@query
def clean_lines(ws):
    return comparable(ws.clean)


@query
def filter_sales(ws):
    return comparable(ws.line_sales)


@query
def filter_customer_sales(ws):
    return comparable(cleaning.filter_customer_sales(ws.line_sales))


@query
def assert_expectations(ws):
    return cleaning.assert_expectations(ws.line_sales, strict=True)


@query
def assert_expectations_clean(ws):
    """The same expectations on all clean lines, where they do not hold."""
    return cleaning.assert_expectations(ws.clean)


@query
def watch_expectations(ws):
    """The expectations on clean lines, counted while these are staged."""
    frame, result = cleaning.watch_expectations(ws.clean)
    stage(frame, "watched")
    return result()


@query
def cleaning_report(ws):
    return cleaning.cleaning_report(ws.raw, ws.clean)


@query
def cleaning_report_unlabelled(ws):
    return cleaning.cleaning_report(ws.raw, ws.clean, ignoring_source=True)


PREVIEW = ["invoice", "stock_code", "description", "quantity", "price", "customer_id"]


@query
def preview_where(ws):
    rows = cleaning.preview_where(ws.clean, F.col("price") <= 0, PREVIEW, _row_order(), 20)
    return comparable(rows)


@query
def preview_negative_quantity(ws):
    return comparable(cleaning.preview_where(ws.raw, F.col("quantity") < 0, PREVIEW, _row_order(), 10))


@query
def preview_missing_description(ws):
    rows = cleaning.preview_where(ws.raw, F.col("description").isNull(), PREVIEW, _row_order(), 10)
    return comparable(rows)


@query
def preview_cancelled(ws):
    return comparable(cleaning.preview_where(ws.raw, cleaning.cancelled("invoice"), PREVIEW, _row_order(), 5))


@query
def preview_head(ws):
    return comparable(cleaning.preview_where(ws.raw, None, RETAIL.raw, _row_order(), 5))


@query
def service_code_list(ws):
    return cleaning.service_code_list(ws.clean)


# --- profiling -----------------------------------------------------------------------------


@query
def profile_shape(ws):
    return profiling.profile_shape(ws.raw)


@query
def profile_schema(ws):
    return profiling.profile_schema(ws.raw.select(*RETAIL.raw))


@query
def profile_main_info(ws):
    return profiling.profile_main_info(ws.raw)


@query
def profile_time_range(ws):
    return profiling.profile_time_range(ws.raw)


@query
def value_counts(ws):
    return profiling.value_counts(ws.raw, "source_period")


@query
def value_counts_country(ws):
    return profiling.value_counts(ws.raw, "country", 15)


@query
def value_counts_description(ws):
    return profiling.value_counts(ws.raw, "description", 20)


@query
def value_counts_segment(ws):
    return profiling.value_counts(_segments(ws), "segment")


@query
def missing_profile(ws):
    return comparable(profiling.missing_profile(ws.raw))


@query
def missing_columns(ws):
    return comparable(profiling.missing_profile(ws.raw, only_missing=True))


@query
def describe_numeric(ws):
    return _described(profiling.describe_numeric(ws.raw, ["quantity", "price"]))


@query
def describe_clean(ws):
    return _described(profiling.describe_numeric(ws.clean, NUMBERS))


@query
def describe_sales(ws):
    return _described(profiling.describe_numeric(ws.line_sales, NUMBERS))


@query
def quantile_table(ws):
    table = profiling.quantile_table(ws.line_sales, NUMBERS)
    return comparable(table, **{name: 6 for name in table.columns if name != "field"})


@query
def duplicate_stats(ws):
    return comparable(profiling.duplicate_stats(ws.raw))


@query
def duplicate_rows(ws):
    return comparable(profiling.duplicate_rows(ws.raw.select(*RETAIL.raw), 10))


@query
def duplicate_rows_all(ws):
    return comparable(profiling.duplicate_rows(ws.raw.select(*RETAIL.raw), None))


@query
def cancellation_stats(ws):
    return comparable(profiling.cancellation_stats(ws.raw))


@query
def suspicious_values(ws):
    return profiling.suspicious_values(ws.raw)


@query
def price_checks(ws):
    return profiling.named_counts(
        ws.clean,
        {
            "negative_price": F.col("price") < 0,
            "zero_price": F.col("price") == 0,
            "missing_customer_id": F.col("customer_id").isNull(),
            "missing_description": F.col("description").isNull(),
        },
    )


@query
def crosstab_flags(ws):
    return profiling.crosstab_flags(ws.raw, F.col("quantity") < 0, cleaning.cancelled("invoice"), "negative")


@query
def crosstab_flags_clean(ws):
    return profiling.crosstab_flags(ws.clean, F.col(RETAIL.negative), F.col(RETAIL.cancelled), "negative")


@query
def distinct_counts(ws):
    return profiling.distinct_counts(ws.raw)


@query
def distinct_by_group(ws):
    return profiling.distinct_by_group(ws.raw, "country", "invoice", "invoices", 15)


@query
def top_n_rows(ws):
    columns = ["invoice", "stock_code", "description", "quantity", "price", "line_total", "customer_id", "country"]
    rows = profiling.top_n_rows(ws.line_sales, "line_total", 15, columns, _row_order())
    return comparable(rows)


# --- keys and consistency ------------------------------------------------------------------


@query
def fd_check(ws):
    return consistency.invoice_fd_check(ws.clean)


@query
def multi_date_rows(ws):
    return consistency.multi_date_rows(ws.clean)


@query
def multi_date_rows_all(ws):
    return consistency.multi_date_rows(ws.clean, None)


@query
def invoice_time_spread(ws):
    return comparable(consistency.invoice_time_spread(ws.clean), diff_minutes=6)


@query
def invoice_time_spread_describe(ws):
    return _described(consistency.invoice_time_spread_describe(ws.clean))


@query
def invoice_time_spread_top(ws):
    return comparable(consistency.invoice_time_spread_top(ws.clean), diff_minutes=6)


@query
def customer_country_check(ws):
    return consistency.customer_country_check(ws.clean)


@query
def product_description_check(ws):
    return consistency.product_description_check(ws.clean)


@query
def product_description_top(ws):
    return consistency.product_description_top(ws.clean)


@query
def description_variants(ws):
    return consistency.description_variants(ws.clean, VARIANT_CODE)


# --- entities ------------------------------------------------------------------------------


@query
def dim_customers(ws):
    return entities.dim_customers(ws.clean)


@query
def dim_products(ws):
    return entities.dim_products(ws.clean)


@query
def dim_products_keep_empty(ws):
    """Empty descriptions may win; here those that consist of a brand alone are emptied."""
    emptied = F.when(F.col("description").rlike("^[A-Z]"), "").otherwise(F.col("description"))
    return entities.dim_products(ws.clean.withColumn("description", emptied), keep_empty=True)


@query
def fact_orders(ws):
    return entities.fact_orders(ws.clean)


@query
def fact_order_items(ws):
    return comparable(entities.fact_order_items(ws.clean))


@query
def normalise(ws):
    """Rows and totals of all four entities made in one go."""
    made = entities.normalise(ws.clean)
    summary = {
        "customers": F.sum(F.col("customer_id").cast("bigint")),
        "products": F.count("description"),
        "orders": F.count("customer_id"),
        "order_items": F.sum("order_item_id"),
    }
    return reduce(
        DataFrame.unionByName,
        [
            frame.agg(F.count("*").alias("rows"), summary[name].cast("double").alias("mark")).select(
                F.lit(name).alias("table_name"), "rows", "mark"
            )
            for name, frame in made.items()
        ],
    )


# --- checks --------------------------------------------------------------------------------


@query
def table_row_counts(ws):
    return checks.table_row_counts(ws.entities)


@query
def check_unique(ws):
    return checks.check_all_unique(ws.entities)


@query
def check_unique_violated(ws):
    """The invoice is no key of the clean lines: how many lines repeat one."""
    return checks.check_unique(ws.clean, "invoice", "clean_lines")


@query
def check_fk_items_orders(ws):
    return checks.check_fk_items_orders(ws.order_items, ws.orders)


@query
def check_fk_items_orders_violated(ws):
    """Lines that point to cancelled orders when only standing orders are kept."""
    return checks.check_fk_items_orders(ws.order_items, ws.orders.filter(~F.col("is_cancelled")))


def _some_missing(ws: Workspace, name: str) -> DataFrame:
    """The order items with every 101st value of a column missing."""
    return ws.order_items.withColumn(name, F.when(F.col("order_item_id") % 101 != 0, F.col(name)))


@query
def check_fk_items_orders_missing(ws):
    """A line without an invoice has no order."""
    return checks.check_fk_items_orders(_some_missing(ws, "invoice"), ws.orders)


@query
def check_fk_items_products_missing(ws):
    return checks.check_fk_items_products(_some_missing(ws, "stock_code"), ws.products)


@query
def check_fk_orders_customers_missing(ws):
    """An order without a customer refers to none."""
    missing = F.when(~F.col("invoice").endswith("7"), F.col("customer_id"))
    return checks.check_fk_orders_customers(ws.orders.withColumn("customer_id", missing), ws.customers)


@query
def check_fk_items_products(ws):
    return checks.check_fk_items_products(ws.order_items, ws.products)


@query
def check_fk_items_products_violated(ws):
    """Lines that lose their product when only described products are kept."""
    return checks.check_fk_items_products(ws.order_items, ws.products.filter(F.col("description").isNotNull()))


@query
def check_fk_orders_customers(ws):
    return checks.check_fk_orders_customers(ws.orders, ws.customers)


@query
def check_fk_orders_customers_violated(ws):
    """Orders that lose their customer when only repeat customers are kept."""
    repeat = customers.orders_per_customer(ws.receipts).filter(F.col("orders_count") > 5)
    return checks.check_fk_orders_customers(ws.orders, repeat)


@query
def check_not_null(ws):
    return checks.check_not_null(ws.entities)


@query
def check_domain(ws):
    return checks.check_domain(ws.entities)


@query
def check_not_null_violated(ws):
    """Every 101st line without a quantity, and orders whose country is lost."""
    orders = ws.orders.withColumn("country", F.when(~F.col("invoice").endswith("7"), F.col("country")))
    return checks.check_not_null({**ws.entities, "orders": orders, "order_items": _some_missing(ws, "quantity")})


@query
def check_domain_violated(ws):
    """Codes and countries that are too long, prices beyond their type."""
    long_code = F.when(F.col("stock_code").endswith("7"), F.repeat("stock_code", F.lit(31))).otherwise(F.col("stock_code"))
    long_name = F.when(F.col("country") == "EIRE", F.repeat("country", F.lit(30))).otherwise(F.col("country"))
    price = F.col("price").cast("double") * F.when(F.col("order_item_id") % 101 == 0, 1e14).otherwise(1)
    return checks.check_domain(
        {
            **ws.entities,
            "products": ws.products.withColumn("stock_code", long_code),
            "orders": ws.orders.withColumn("country", long_name),
            "order_items": ws.order_items.withColumn("price", price),
        }
    )


@query
def check_line_total_violated(ws):
    """Line totals that are off by two cents, and others by half a cent, which is within the tolerance."""
    off = F.when(F.col("order_item_id") % 101 == 0, 0.02).when(F.col("order_item_id") % 103 == 0, 0.005).otherwise(0)
    return checks.check_line_total(ws.order_items.withColumn("line_total", F.col("line_total") + off.cast("decimal(18,4)")))


@query
def check_cancelled_flag(ws):
    return checks.check_cancelled_flag(ws.orders)


@query
def check_line_total(ws):
    return checks.check_line_total(ws.order_items)


@query
def check_missing_description(ws):
    return checks.check_missing_description(ws.products)


@query
def check_value_signs(ws):
    return checks.check_value_signs(ws.order_items)


@query
def sales_row_counts(ws):
    return checks.sales_row_counts(ws.sales)


@query
def sales_row_counts_by_line(ws):
    return checks.sales_row_counts(ws.line_sales)


@query
def sales_overview(ws):
    return comparable(sales.sales_overview(ws.sales, ws.receipts))


@query
def sales_overview_by_line(ws):
    return comparable(sales.sales_overview(ws.line_sales, ws.line_receipts))


# --- views ---------------------------------------------------------------------------------


@query
def v_sales(ws):
    return comparable(views.v_sales(ws.order_items, ws.orders, ws.products))


@query
def v_customer_sales(ws):
    return comparable(views.v_customer_sales(ws.sales))


@query
def v_invoice_summary(ws):
    return comparable(views.v_invoice_summary(ws.receipts))


@query
def v_monthly_metrics(ws):
    return comparable(views.v_monthly_metrics(ws.receipts))


# --- sales over time -----------------------------------------------------------------------


def _monthly(ws: Workspace) -> DataFrame:
    return views.v_monthly_metrics(ws.receipts)


@query
def core_metrics(ws):
    return comparable(sales.core_metrics(ws.sales, ws.receipts))


@query
def core_metrics_by_line(ws):
    return comparable(sales.core_metrics(ws.line_sales, ws.line_receipts))


@query
def monthly_metrics(ws):
    return comparable(sales.monthly_metrics(ws.receipts))


@query
def monthly_metrics_by_line(ws):
    return comparable(sales.monthly_metrics(ws.line_receipts))


@query
def full_months(ws):
    return comparable(sales.full_months(_monthly(ws)))


@query
def full_months_by_line(ws):
    return comparable(sales.full_months(views.v_monthly_metrics(ws.line_receipts)))


@query
def best_worst_month(ws):
    return comparable(sales.best_worst_month(sales.full_months(_monthly(ws))))


@query
def best_worst_month_by_line(ws):
    return comparable(sales.best_worst_month(sales.full_months(views.v_monthly_metrics(ws.line_receipts))))


@query
def mom_growth(ws):
    return comparable(sales.mom_growth(_monthly(ws)))


@query
def mom_growth_filled(ws):
    return comparable(sales.mom_growth(_monthly(ws), fill_months=True))


@query
def yoy_compare(ws):
    return comparable(sales.yoy_compare(_monthly(ws), *YEARS))


@query
def yoy_compare_by_line(ws):
    return comparable(sales.yoy_compare(views.v_monthly_metrics(ws.line_receipts), *YEARS))


# --- customers -----------------------------------------------------------------------------


def _orders(ws: Workspace) -> DataFrame:
    return customers.orders_per_customer(ws.receipts)


def _activity(ws: Workspace) -> DataFrame:
    return customers.cohort_activity(ws.receipts)


def _segments(ws: Workspace) -> DataFrame:
    return customers.rfm_segments(ws.scores)


@query
def orders_per_customer(ws):
    return _orders(ws)


@query
def orders_per_customer_by_line(ws):
    return customers.orders_per_customer(ws.line_receipts)


@query
def repeat_rate(ws):
    return comparable(customers.repeat_rate(_orders(ws)))


@query
def repeat_rate_by_line(ws):
    return comparable(customers.repeat_rate(customers.orders_per_customer(ws.line_receipts)))


@query
def orders_distribution(ws):
    return _described(customers.orders_distribution(_orders(ws)))


@query
def orders_distribution_by_line(ws):
    return _described(customers.orders_distribution(customers.orders_per_customer(ws.line_receipts)))


@query
def orders_histogram(ws):
    return comparable(customers.orders_histogram(_orders(ws)), bin_from=6, bin_to=6)


@query
def order_groups(ws):
    return comparable(customers.order_groups(_orders(ws)))


@query
def order_groups_by_line(ws):
    return comparable(customers.order_groups(customers.orders_per_customer(ws.line_receipts), fill=True))


@query
def order_groups_filled(ws):
    return comparable(customers.order_groups(_orders(ws), fill=True))


@query
def cohort_activity(ws):
    return _activity(ws)


@query
def month_sets(ws):
    """Months a customer bought in, from the bits of their set."""
    sets = customers.month_sets(ws.receipts)
    months = F.aggregate("months", F.lit(0), lambda n, bits: n + F.bit_count(bits))
    return sets.select("customer_id", months.alias("active_months"))


@query
def cohort_activity_merged(ws):
    """The activity of two loads, kept as month sets that merge."""
    first, last = "1995-01-01", "2001-12-31"
    early = F.col("invoice_date") < F.lit("1998-04-15").cast("timestamp_ntz")
    parts = [
        customers.month_sets(dataclasses.replace(ws.receipts, rows=ws.receipts.rows.filter(part)), first, last)
        for part in (early, ~early)
    ]
    return customers.activity_of_sets(customers.merge_month_sets(*parts))


@query
def cohort_retention(ws):
    return comparable(customers.cohort_retention(_activity(ws), FIRST_COHORT, LAST_COHORT))


@query
def cohort_retention_by_line(ws):
    activity = customers.cohort_activity(ws.line_receipts)
    return comparable(customers.cohort_retention(activity, FIRST_COHORT, LAST_COHORT))


@query
def retention_matrix(ws):
    """Every month that any cohort has seen."""
    return comparable(customers.retention_matrix(_activity(ws)))


@query
def retention_heatmap(ws):
    return comparable(customers.retention_matrix(_activity(ws), range(1, 7), FIRST_COHORT, LAST_COHORT))


@query
def retention_summary(ws):
    rows = customers.retention_summary(_activity(ws), first=FIRST_COHORT, last=LAST_COHORT)
    return comparable(rows)


@query
def retention_summary_mean(ws):
    return comparable(customers.retention_summary_mean(_activity(ws), first=FIRST_COHORT, last=LAST_COHORT))


@query
def rfm_customer(ws):
    return comparable(customers.rfm_customer(ws.receipts))


@query
def rfm_customer_elapsed(ws):
    return comparable(customers.rfm_customer(ws.line_receipts, recency="elapsed"))


@query
def rfm_quantiles(ws):
    frame = customers.rfm_quantiles(ws.rfm)
    return comparable(frame, **{name: 6 for name in frame.columns})


@query
def rfm_scores(ws):
    return comparable(customers.rfm_scores(ws.rfm))


@query
def rfm_segments(ws):
    return comparable(_segments(ws))


@query
def rfm_segments_elapsed(ws):
    rfm = customers.rfm_customer(ws.line_receipts, recency="elapsed")
    return comparable(customers.rfm_segments(customers.rfm_scores(rfm)))


@query
def rfm_describe(ws):
    return _described(customers.rfm_describe(ws.rfm))


@query
def rfm_describe_scores(ws):
    columns = ["r_score", "f_score", "m_score", "rfm_score"]
    return _described(customers.rfm_describe(ws.scores, customers.QUARTILES, columns))


@query
def rfm_segment_summary(ws):
    return comparable(customers.rfm_segment_summary(_segments(ws)))


@query
def rfm_segment_summary_elapsed(ws):
    rfm = customers.rfm_customer(ws.line_receipts, recency="elapsed")
    return comparable(customers.rfm_segment_summary(customers.rfm_segments(customers.rfm_scores(rfm))))


@query
def segment_actions(ws):
    return customers.segment_actions(customers.rfm_segment_summary(_segments(ws)))


# --- countries, products, activity ---------------------------------------------------------


@query
def country_summary(ws):
    return comparable(sales.country_summary(ws.receipts))


@query
def country_summary_by_line(ws):
    return comparable(sales.country_summary(ws.line_receipts, 15))


@query
def home_country_share(ws):
    return comparable(sales.home_country_share(ws.receipts, HOME))


@query
def home_country_share_by_line(ws):
    return comparable(sales.home_country_share(ws.line_receipts, HOME))


@query
def top_countries_excluding(ws):
    return comparable(sales.top_countries_excluding(ws.receipts, HOME))


@query
def top_countries_excluding_by_line(ws):
    return comparable(sales.top_countries_excluding(ws.line_receipts, HOME))


@query
def product_summary(ws):
    return comparable(sales.product_summary(ws.sales, ws.products, 20))


@query
def product_summary_by_line(ws):
    return comparable(sales.product_summary(ws.line_sales, ws.products, 15))


@query
def product_summary_by_quantity(ws):
    return comparable(sales.product_summary(ws.line_sales, ws.products, 15, by="quantity"))


@query
def product_summary_line_descriptions(ws):
    return comparable(sales.product_summary(ws.line_sales, ws.products, 15, line_descriptions=True))


@query
def product_summary_all(ws):
    return comparable(sales.product_summary(ws.sales, ws.products))


@query
def top_products_ascending(ws):
    return comparable(sales.top_products_ascending(ws.sales, ws.products))


@query
def product_concentration(ws):
    return comparable(sales.product_concentration(ws.sales))


@query
def product_concentration_by_line(ws):
    return comparable(sales.product_concentration(ws.line_sales))


@query
def weekday_activity(ws):
    return sales.weekday_activity(ws.receipts)


@query
def weekday_activity_by_time(ws):
    return sales.weekday_activity(ws.line_receipts, unit="invoice_ts", fill_days=True)


@query
def weekday_activity_filled(ws):
    return sales.weekday_activity(ws.receipts, fill_days=True)


@query
def busiest_weekday(ws):
    days = sales.weekday_activity(ws.line_receipts, unit="invoice_ts")
    return sales.busiest(days, "weekday", "weekday_number")


@query
def hour_activity(ws):
    return sales.hour_activity(ws.receipts)


@query
def hour_activity_by_time(ws):
    return sales.hour_activity(ws.line_receipts, unit="invoice_ts", by_hour=True)


@query
def busiest_hour(ws):
    return sales.busiest(sales.hour_activity(ws.line_receipts, unit="invoice_ts"), "hour", "hour")


@query
def known_unknown_revenue(ws):
    return comparable(sales.known_unknown_revenue(ws.receipts))


def query_named(name: str) -> Query:
    return _QUERIES[name]


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries as callables of a session and an input folder."""

    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: workspace(spark, sf_dir).run(fn)

    return {name: bind(fn) for name, fn in _QUERIES.items()}
