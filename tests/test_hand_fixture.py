"""The sixteen hand-written lines with the values worked out for them."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.functions.columns import LineColumns
from tillroll.operators import checks, cleaning, consistency, customers, entities, profiling, sales, views


def rows(df):
    return [tuple(row) for row in df.collect()]


def month(text):
    return datetime.date.fromisoformat(text + "-01")


def test_clean_counts(raw, clean):
    assert raw.count() == 16
    assert clean.count() == 15
    assert cleaning.clean_lines(raw, ignore=["source_period"]).count() == 14
    assert dict(rows(cleaning.cleaning_report(raw, clean, ignoring_source=True))) == {
        "raw_rows": 16, "clean_rows": 15, "sales_rows": 11, "customer_sales_rows": 9, "duplicates_removed": 1,
        "cancelled_rows": 1, "negative_quantity_rows": 2, "service_rows": 2, "duplicates_ignoring_source": 2,
    }


def test_duplicates_removed(raw):
    trimmed = cleaning.trim_strings(raw)
    assert rows(cleaning.duplicates_removed(trimmed)) == [(16, 1, 15)]
    assert rows(cleaning.duplicates_removed(trimmed, ignore=["source_period"])) == [(16, 2, 14)]
    assert rows(profiling.duplicate_stats(raw)) == [(1, Decimal("6.25"))]


def test_duplicate_members(raw):
    both = profiling.duplicate_rows(raw, None)
    assert both.count() == 2 and both.distinct().count() == 1
    assert rows(profiling.duplicate_rows(raw, 1)) == rows(both.limit(1))


def test_sales(raw, clean, sales_view):
    sold = cleaning.filter_sales(clean)
    assert sold.count() == 11
    assert cleaning.filter_customer_sales(sold).count() == 9
    assert views.v_customer_sales(sales_view).count() == 10
    assert rows(cleaning.assert_expectations(sold, strict=True)) == [
        ("no_cancelled", 0, True), ("no_service", 0, True), ("positive_quantity", 0, True), ("positive_price", 0, True)
    ]
    with pytest.raises(cleaning.ExpectationError, match="no_cancelled.*positive_price"):
        cleaning.assert_expectations(clean, strict=True)


def test_unknown_predicate_fails(raw):
    found = cleaning.assert_expectations(raw, {"known": F.col("customer_id") > 0})
    assert rows(found) == [("known", 4, False)]


def test_entities(tables):
    assert sorted(rows(tables["customers"])) == [(1,), (2,), (3,), (4,)]
    assert dict(rows(tables["products"])) == {
        "A1": "RED CUP", "A2": "BLUE CUP", "A3": None, "A4": "LAMP", "A5": None, "B": "Adjust bad debt",
        "POST": "POSTAGE",
    }
    assert tables["orders"].count() == 11
    by_invoice = {row["invoice"]: row for row in tables["orders"].collect()}
    assert by_invoice["109"]["customer_id"] == 2
    assert by_invoice["100"]["invoice_date"] == datetime.datetime(2010, 1, 5, 9, 0)
    assert [row["is_cancelled"] for key, row in sorted(by_invoice.items()) if key in ("C102", "c108")] == [True, False]
    assert sorted(row["order_item_id"] for row in tables["order_items"].collect()) == list(range(1, 16))


def test_empty_description_can_be_kept(clean):
    assert dict(rows(entities.dim_products(clean, keep_empty=True)))["A5"] == ""


def test_checks(tables):
    checks.require_valid(tables)
    assert rows(checks.check_cancelled_flag(tables["orders"])) == [(1,)]
    assert rows(checks.check_missing_description(tables["products"])) == [(2,)]
    assert rows(checks.check_value_signs(tables["order_items"])) == [(2, 1, 1)]
    assert rows(checks.check_line_total(tables["order_items"])) == [(0,)]
    assert dict(rows(checks.table_row_counts(tables))) == {
        "customers": 4, "products": 7, "orders": 11, "order_items": 15
    }


def test_broken_tables_are_refused(tables):
    broken = dict(tables)
    broken["orders"] = tables["orders"].filter("invoice <> '100'").withColumn(
        "country", F.when(F.col("invoice") != "101", F.col("country"))
    )
    broken["products"] = tables["products"].unionAll(tables["products"].filter("stock_code = 'A1'")).withColumn(
        "stock_code", F.when(F.col("stock_code") == "A2", F.repeat(F.lit("x"), 31)).otherwise(F.col("stock_code"))
    )
    broken["customers"] = tables["customers"].filter("customer_id <> 3")
    found = dict(rows(checks.constraint_violations(broken).filter("violations > 0")))
    assert found == {
        "unique products": 1, "items_without_order": 2, "items_without_product": 4,
        "orders_without_known_customer": 1, "not null orders.country": 1, "domain products.stock_code": 1,
    }
    with pytest.raises(checks.ConstraintError, match="unique products: 1"):
        checks.require_valid(broken)


def test_consistency(clean):
    assert sorted(rows(consistency.invoice_fd_check(clean))) == [
        ("countries", 1, 0), ("customers", 1, 0), ("dates", 2, 1)
    ]
    assert [row["invoice"] for row in consistency.multi_date_rows(clean).collect()] == ["100", "100"]
    assert [row["diff_minutes"] for row in consistency.invoice_time_spread(clean).collect()] == [1.0]
    assert rows(consistency.customer_country_check(clean)) == [(1, 2)]
    assert rows(consistency.product_description_check(clean)) == [(2, 2)]
    assert rows(consistency.description_variants(clean, "A4")) == [("A4", "LAMP"), ("A4", "lamp")]


def test_core_metrics(sales_view, receipts):
    expected = [(11, 8, 4, 4, Decimal("1110.50"), Decimal("138.81"))]
    assert rows(sales.core_metrics(sales_view, receipts)) == expected
    assert rows(sales.core_metrics(sales_view, receipts)) == expected


def test_receipts_of_lines_do_not_pass_for_invoices(clean, sales_view):
    lines = cleaning.filter_sales(clean)
    with pytest.raises(ValueError, match="v_sales"):
        views.invoice_receipts(lines)
    assert not views.receipts(lines).by_invoice and views.invoice_receipts(sales_view).by_invoice


def test_lines_without_a_key_are_orphans(tables):
    items = tables["order_items"].withColumns(
        {name: F.when(F.col("order_item_id") > 1, F.col(name)) for name in ("invoice", "stock_code")}
    )
    assert rows(checks.check_fk_items_orders(items, tables["orders"])) == [(1,)]
    assert rows(checks.check_fk_items_products(items, tables["products"])) == [(1,)]
    assert rows(checks.check_fk_orders_customers(tables["orders"], tables["customers"])) == [(0,)]


def test_unlisted_label_fails(raw):
    with pytest.raises(Exception, match="unlisted value"):
        cleaning.drop_exact_duplicates(raw, ignore=["source_period"], values={"source_period": ["P1"]}).collect()


def test_retention_matrix_holds_every_month(receipts):
    activity = customers.cohort_activity(receipts)
    matrix = customers.retention_matrix(activity)
    cells = {
        (row["cohort_month"], int(name.removeprefix("month_")))
        for row in matrix.collect() for name in matrix.columns[1:] if row[name] is not None
    }
    assert cells == {tuple(r) for r in customers.cohort_sizes(activity).select("cohort_month", "month_number").collect()}
    assert customers.retention_matrix(activity.limit(0)).count() == 0


def test_months(receipts):
    monthly = sales.monthly_metrics(receipts)
    assert [(r["month"], r["invoices"], r["customers"], r["revenue"]) for r in monthly.collect()] == [
        (month("2010-01"), 1, 1, Decimal("7.00")), (month("2010-02"), 2, 2, Decimal("36.50")),
        (month("2010-03"), 4, 2, Decimal("67.00")), (month("2011-01"), 1, 1, Decimal("1000.00")),
    ]
    assert rows(sales.monthly_metrics(receipts)) == rows(monthly)
    growth = sales.mom_growth(monthly).collect()
    assert [r["revenue_growth_pct"] for r in growth] == [
        None, Decimal("421.43"), Decimal("83.56"), Decimal("1392.54")
    ]
    filled = sales.mom_growth(monthly, fill_months=True).collect()
    assert len(filled) == 13 and filled[-1]["previous_revenue"] is None
    assert [r["month"] for r in sales.full_months(monthly).collect()] == [month("2010-02"), month("2010-03")]
    assert sales.full_months(monthly, "2009-12-01", "2010-02-01").count() == 1
    assert [(r["kind"], r["month"]) for r in sales.best_worst_month(monthly).collect()] == [
        ("best", month("2011-01")), ("worst", month("2010-01"))
    ]
    assert rows(sales.yoy_compare(monthly, 2010, 2011))[0] == (
        1, Decimal("7.00"), Decimal("1000.00"), Decimal("14185.71")
    )


def test_best_month_takes_the_first_of_a_tie(receipts):
    tied = sales.monthly_metrics(receipts).withColumn("revenue", F.lit(Decimal("5.00")))
    assert {r["month"] for r in sales.best_worst_month(tied).collect()} == {month("2010-01")}


def test_countries(receipts):
    summary = sales.country_summary(receipts)
    assert [(r["country"], r["revenue"], r["invoices"]) for r in summary.collect()] == [
        ("EIRE", Decimal("1040.00"), 2), ("France", Decimal("43.50"), 4), ("United Kingdom", Decimal("27.00"), 2)
    ]
    assert rows(sales.home_country_share(receipts, "United Kingdom")) == [("United Kingdom", Decimal("2.43"))]
    assert rows(sales.home_country_share(receipts, "Atlantis")) == [("Atlantis", None)]
    assert [r["country"] for r in sales.top_countries_excluding(receipts, "EIRE").collect()] == [
        "United Kingdom", "France"
    ]


def test_products(sales_view, tables):
    summary = sales.product_summary(sales_view, tables["products"])
    assert [(r["stock_code"], r["description"], r["revenue"]) for r in summary.collect()] == [
        ("A5", None, Decimal("1000.00")), ("A4", "LAMP", Decimal("60.00")), ("A2", "BLUE CUP", Decimal("32.00")),
        ("A1", "RED CUP", Decimal("18.50")),
    ]
    best = sales.product_summary(sales_view, tables["products"], 1, by="quantity")
    assert [(r["stock_code"], r["quantity"]) for r in best.collect()] == [("A1", 14)]
    assert rows(sales.product_concentration(sales_view, (1, 3))) == [(Decimal("90.05"), Decimal("98.33"))]


def test_activity(clean, receipts):
    assert dict(rows(sales.hour_activity(receipts))) == {8: 1, 9: 1, 11: 1, 12: 3, 15: 2}
    lines = views.receipts(cleaning.filter_sales(clean))
    assert dict(rows(sales.hour_activity(lines, unit="invoice_ts", by_hour=True)))[9] == 2
    assert dict(rows(sales.hour_activity(lines)))[9] == 1
    assert rows(sales.busiest(sales.hour_activity(receipts), "hour", "hour")) == [(12, 3)]
    week = sales.weekday_activity(receipts, fill_days=True)
    assert [r["weekday_number"] for r in week.collect()] == list(range(1, 8))
    assert {r["weekday"]: r["invoices"] for r in week.collect()}["Monday"] == 1
    with pytest.raises(ValueError, match="unit"):
        sales.weekday_activity(receipts, unit="line")


def test_known_and_unknown(receipts):
    assert rows(sales.known_unknown_revenue(receipts)) == [
        ("known customer", 7, Decimal("1090.50"), Decimal("98.20")),
        ("unknown customer", 1, Decimal("20.00"), Decimal("1.80")),
    ]


def test_repeat(receipts):
    orders = customers.orders_per_customer(receipts)
    assert dict(rows(orders)) == {1: 2, 2: 3, 3: 1, 4: 1}
    assert rows(customers.repeat_rate(orders)) == [(4, 2, 2, Decimal("50.00"))]
    assert rows(customers.order_groups(orders)) == [("1", 2, Decimal("50.00")), ("2-5", 2, Decimal("50.00"))]
    assert [r["customers"] for r in customers.order_groups(orders, fill=True).collect()] == [2, 2, 0, 0]


def test_histogram(receipts, spark):
    orders = customers.orders_per_customer(receipts)
    bars = customers.orders_histogram(orders, upper=1.0, bins=4)
    assert rows(bars) == [(1, 1.0, 1.5, 2), (2, 1.5, 2.0, 0), (3, 2.0, 2.5, 1), (4, 2.5, 3.0, 1)]
    single = spark.createDataFrame([(1, 5), (2, 5)], "customer_id int, orders_count long")
    assert [r for r in rows(customers.orders_histogram(single, bins=4)) if r[3]] == [(3, 5.0, 5.25, 2)]
    assert customers.orders_histogram(single.limit(0)).count() == 0


def test_cohorts(receipts):
    activity = customers.cohort_activity(receipts)
    assert sorted(rows(activity)) == sorted(
        [
            (1, month("2010-01"), month("2010-01"), 0), (1, month("2010-01"), month("2010-02"), 1),
            (2, month("2010-02"), month("2010-02"), 0), (2, month("2010-02"), month("2010-03"), 1),
            (3, month("2010-03"), month("2010-03"), 0), (4, month("2011-01"), month("2011-01"), 0),
        ]
    )
    assert rows(customers.cohort_retention(activity)) == [
        (month("2010-01"), 1, 1, 1, Decimal("100.00")), (month("2010-02"), 1, 1, 1, Decimal("100.00"))
    ]
    matrix = customers.retention_matrix(activity, [0, 1])
    assert [r["month_1"] for r in matrix.collect()] == [Decimal("100.00"), Decimal("100.00"), None, None]
    mean = customers.retention_summary_mean(activity, (1, 3), "2010-02-01", "2011-01-01")
    assert rows(mean) == [(Decimal("100.00"), None)]


def test_rfm(receipts):
    calendar = {r["customer_id"]: tuple(r)[1:] for r in customers.rfm_customer(receipts).collect()}
    assert calendar == {
        1: (356, 2, Decimal("31.0000")), 2: (331, 3, Decimal("19.5000")), 3: (334, 1, Decimal("40.0000")),
        4: (1, 1, Decimal("1000.0000")),
    }
    elapsed = customers.rfm_customer(receipts, recency="elapsed")
    assert {r["customer_id"]: r["recency"] for r in elapsed.collect()} == {1: 355, 2: 330, 3: 333, 4: 1}
    quartiles = customers.rfm_quantiles(customers.rfm_customer(receipts))
    assert rows(quartiles) == [(248.5, 332.5, 339.5, 1.0, 1.5, 2.25, 28.125, 35.5, 280.0)]


def test_rfm_segments(receipts):
    segments = customers.rfm_segments(customers.rfm_scores(customers.rfm_customer(receipts)))
    found = {r["customer_id"]: (r["r_score"], r["f_score"], r["m_score"], r["segment"]) for r in segments.collect()}
    assert found == {
        1: (1, 3, 2, "At risk"), 2: (3, 4, 1, "Loyal customers"), 3: (2, 1, 3, "Hibernating"),
        4: (4, 1, 4, "New customers"),
    }
    summary = customers.rfm_segment_summary(segments)
    assert [(r["segment"], r["customers"], r["revenue"]) for r in summary.collect()] == [
        ("New customers", 1, Decimal("1000.00")), ("Hibernating", 1, Decimal("40.00")),
        ("At risk", 1, Decimal("31.00")), ("Loyal customers", 1, Decimal("19.50")),
    ]
    assert all(r["action"] for r in customers.segment_actions(summary).collect())


def test_segment_rules_cover_every_score(spark):
    grid = spark.range(1, 5).selectExpr("cast(id as int) as r_score").crossJoin(
        spark.range(1, 5).selectExpr("cast(id as int) as f_score")
    )
    named = {(r["r_score"], r["f_score"]): r["segment"] for r in customers.rfm_segments(grid).collect()}
    assert len(named) == 16 and None not in named.values()
    assert (named[4, 4], named[4, 3], named[3, 4]) == ("Champions", "Loyal customers", "Loyal customers")
    assert (named[4, 2], named[4, 1], named[3, 1]) == ("Potential loyalists", "New customers", "Promising")
    assert (named[2, 4], named[1, 3], named[2, 2]) == ("At risk", "At risk", "Hibernating")
    bare = spark.createDataFrame([("Promising", 1)], "segment string, customers long")
    assert rows(customers.segment_actions(bare)) == [("Promising", 1, None)]


def test_profile(raw):
    assert rows(profiling.profile_shape(raw)) == [(16, 9)]
    assert rows(profiling.profile_main_info(raw)) == [(16, 11, 8, 4, 3)]
    assert rows(profiling.suspicious_values(raw)) == [(2, 0, 1, 1, 4, 1)]
    assert rows(profiling.cancellation_stats(raw)) == [(1, 1, Decimal("6.25"))]
    assert rows(profiling.value_counts(raw, "country", 2)) == [("United Kingdom", 7), ("France", 7)][::-1]
    assert [r["column_name"] for r in profiling.missing_profile(raw, only_missing=True).collect()] == [
        "description", "customer_id"
    ]
    approx = {r["column_name"]: r["distinct_values"] for r in profiling.distinct_counts(raw, approx=True).collect()}
    assert approx["customer_id"] == 4


def test_cancel_flag_ignores_missing_invoices(spark):
    df = spark.createDataFrame([("C1",), ("c2",), (None,), ("1C",)], "invoice string")
    assert [r["is_cancelled"] for r in cleaning.flag_cancelled(df).collect()] == [True, False, False, False]
    anycase = cleaning.flag_cancelled(df, case_insensitive=True)
    assert [r["is_cancelled"] for r in anycase.collect()] == [True, True, False, False]


def test_casts(spark):
    df = spark.createDataFrame(
        [("17850.0", "1", 2.0, "2010-01-05 09:00:00"), ("1.5", None, 2.5, "nonsense"), (None, "x", None, None)],
        "customer_id string, invoice string, quantity double, invoice_date string",
    )
    types = {"customer_id": cleaning.T.IntegerType(), "quantity": cleaning.T.IntegerType(),
             "invoice_date": cleaning.T.TimestampNTZType()}
    typed = cleaning.cast_types(df, types)
    assert [r["customer_id"] for r in typed.collect()] == [17850, None, None]
    assert [r["quantity"] for r in typed.collect()] == [2, None, None]
    assert dict(rows(cleaning.cast_rejects(df, types))) == {"customer_id": 1, "quantity": 1, "invoice_date": 1}


def test_strip_takes_every_white_space(spark):
    text = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    df = spark.createDataFrame([(text + "a b" + text,), (text,), ("​x",)], "description string")
    assert [r[0] for r in cleaning.trim_strings(df, ["description"]).collect()] == ["a b", "", "​x"]


def test_service_codes_from_a_table(spark, raw):
    codes = spark.createDataFrame([("POST",), ("POST",), ("B",), (None,)], "code string")
    flagged = cleaning.flag_service(raw, codes)
    assert flagged.count() == raw.count()
    assert {r["stock_code"] for r in flagged.filter("is_service").collect()} == {"POST", "B"}
    assert flagged.filter("is_service is null").count() == 0


def test_other_column_names(clean, receipts):
    names = {"invoice": "receipt_no", "customer_id": "client", "invoice_date": "at", "country": "land",
             "stock_code": "sku", "line_total": "amount"}
    c = LineColumns(**names)
    sold = cleaning.filter_sales(clean.withColumnsRenamed(names), c=c)
    rc = views.receipts(sold, c=c)
    plain = views.receipts(cleaning.filter_sales(clean))
    assert rows(sales.monthly_metrics(rc, c=c)) == rows(sales.monthly_metrics(plain))
    assert rows(sales.country_summary(rc, c=c)) == rows(sales.country_summary(plain))
    assert rows(sales.weekday_activity(rc, c=c)) == rows(sales.weekday_activity(plain))
    assert rows(sales.core_metrics(sold, rc, c=c)) == rows(
        sales.core_metrics(cleaning.filter_sales(clean), plain)
    )
    assert sorted(rows(customers.rfm_customer(rc, c=c))) == sorted(rows(customers.rfm_customer(plain)))
    assert customers.cohort_activity(rc, c=c).columns[0] == "client"


@pytest.mark.parametrize("zone", ["America/Sao_Paulo", "Asia/Tokyo"])
def test_session_zone_plays_no_part(spark, clean, receipts, zone):
    def found():
        return [
            rows(sales.weekday_activity(receipts)), rows(sales.hour_activity(receipts)),
            rows(sales.monthly_metrics(receipts)), rows(consistency.invoice_time_spread(clean)),
            sorted(rows(customers.rfm_customer(receipts, recency="elapsed"))),
            sorted(rows(customers.cohort_activity(receipts))),
        ]

    before = found()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert found() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_time_spread_across_a_clock_change(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        df = spark.sql(
            "select '1' as invoice, timestamp_ntz'2011-03-27 00:30:00' as invoice_date"
            " union all select '1', timestamp_ntz'2011-03-27 03:00:30'"
        )
        assert [r["diff_minutes"] for r in consistency.invoice_time_spread(df).collect()] == [150.5]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
