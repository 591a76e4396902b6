"""Sales metrics: totals, months, countries, weekdays and hours, known customers.

Arguments named ``rc`` are receipts (see ``views.Receipts``): those of ``v_sales`` count invoices
as rows, others need a distinct count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import RETAIL, LineColumns
from tillroll.functions.expressions import WEEKDAYS, iso_weekday, money, percent, quotient, weekday_name
from tillroll.operators.views import Receipts, v_monthly_metrics


def _distinct(frame: DataFrame, name: str) -> Column:
    values = frame.select(name).filter(F.col(name).isNotNull()).distinct()
    return values.agg(F.count("*").alias("n")).scalar()


def core_metrics(sales: DataFrame, rc: Receipts, *, c: LineColumns = RETAIL) -> DataFrame:
    """One row: sales rows, invoices, customers, products, revenue, average invoice.

    Only the number of products needs the lines; the rest comes from the receipts.
    """
    totals = rc.rows.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("sales_rows"),
        F.count("*").alias("invoices"),
        F.sum("revenue").alias("total"),
    )
    invoice_count = F.col("invoices") if rc.by_invoice else _distinct(rc.rows, c.invoice)
    return totals.select(
        "sales_rows",
        invoice_count.alias("invoices"),
        _distinct(rc.rows, c.customer_id).alias("customers"),
        _distinct(sales, c.stock_code).alias("products"),
        money(F.col("total")).alias("revenue"),
        quotient(F.col("total"), invoice_count).alias("average_invoice"),
    )


def sales_overview(sales: DataFrame, rc: Receipts, *, c: LineColumns = RETAIL) -> DataFrame:
    """One row: first and last date, invoices, customers, products, revenue."""
    span = rc.rows.agg(
        F.min(c.invoice_date).alias("first_date"),
        F.max(c.invoice_date).alias("last_date"),
        F.count("*").alias("invoices"),
        F.sum("revenue").alias("total"),
    )
    return span.select(
        "first_date", "last_date",
        (F.col("invoices") if rc.by_invoice else _distinct(rc.rows, c.invoice)).alias("invoices"),
        _distinct(rc.rows, c.customer_id).alias("customers"),
        _distinct(sales, c.stock_code).alias("products"),
        money(F.col("total")).alias("revenue"),
    )


def monthly_metrics(rc: Receipts, *, c: LineColumns = RETAIL) -> DataFrame:
    return v_monthly_metrics(rc, c=c).orderBy("month")


def full_months(monthly: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Months strictly between two bounds, by default the first and last (partial) month."""
    everything = Window.partitionBy()
    bounds = {
        "_after": F.lit(first).cast("date") if first else F.min("month").over(everything),
        "_before": F.lit(last).cast("date") if last else F.max("month").over(everything),
    }
    inside = monthly.withColumns(bounds).filter("month > _after and month < _before")
    return inside.drop(*bounds).orderBy("month")


def best_worst_month(monthly: DataFrame) -> DataFrame:
    """The ``best`` and ``worst`` month by revenue; the earlier month wins a tie."""
    row = F.struct(*monthly.columns)
    early = -F.unix_date("month")
    picked = monthly.agg(
        F.max_by(row, F.struct("revenue", early)).alias("best"),
        F.min_by(row, F.struct("revenue", -early)).alias("worst"),
    )
    tagged = [
        F.struct(F.lit(kind).alias("kind"), *[F.col(kind)[name].alias(name) for name in monthly.columns])
        for kind in ("best", "worst")
    ]
    return picked.select(F.inline(F.array(*tagged)))


def mom_growth(monthly: DataFrame, *, fill_months: bool = False) -> DataFrame:
    """(month, revenue, previous_revenue, revenue_growth_pct) against the previous row.

    A calendar month without sales is skipped; ``fill_months`` inserts it without revenue.
    """
    rows = monthly.select("month", "revenue")
    if fill_months:
        following = F.coalesce(F.add_months(F.lead("month").over(Window.orderBy("month")), -1), F.col("month"))
        stretched = rows.withColumn("_until", following).select(
            F.explode(F.sequence("month", "_until", F.expr("interval 1 month"))).alias("at"), "month", "revenue"
        )
        sold = F.when(F.col("at") == F.col("month"), F.col("revenue"))
        rows = stretched.select(F.col("at").alias("month"), sold.alias("revenue"))
    previous = F.lag("revenue").over(Window.orderBy("month"))
    grown = rows.withColumn("previous_revenue", previous)
    change = percent(F.col("revenue") - F.col("previous_revenue"), F.col("previous_revenue"))
    return grown.withColumn("revenue_growth_pct", change).orderBy("month")


def yoy_compare(monthly: DataFrame, earlier: int, later: int, *, last_month: int = 11) -> DataFrame:
    """(month_number, revenue_<earlier>, revenue_<later>, growth_pct) for months 1..last_month."""
    year, number = F.year("month"), F.month("month")
    months = monthly.filter(year.isin(earlier, later) & (number <= last_month))
    of = lambda y: F.max(F.when(year == y, F.col("revenue")))
    table = months.groupBy(number.alias("month_number")).agg(
        of(earlier).alias(f"revenue_{earlier}"), of(later).alias(f"revenue_{later}")
    )
    before, after = F.col(f"revenue_{earlier}"), F.col(f"revenue_{later}")
    return table.withColumn("growth_pct", percent(after - before, before)).orderBy("month_number")


def country_summary(rc: Receipts, n: int | None = None, *, c: LineColumns = RETAIL) -> DataFrame:
    """Revenue, invoices, customers and average invoice per country, highest revenue first."""
    countries = rc.rows.groupBy(c.country).agg(
        F.sum("revenue").alias("total"),
        rc.invoices(c).alias("invoices"),
        F.count_distinct(c.customer_id).alias("customers"),
    )
    ordered = countries.select(
        c.country, money(F.col("total")).alias("revenue"), "invoices", "customers",
        quotient(F.col("total"), F.col("invoices")).alias("average_invoice"),
    ).orderBy(F.desc("revenue"), c.country)
    return ordered if n is None else ordered.limit(n)


def home_country_share(rc: Receipts, home: str, *, c: LineColumns = RETAIL) -> DataFrame:
    """(country, revenue_share): percent of revenue from one country, NULL if it has no sales."""
    at_home = F.sum(F.when(F.col(c.country) == home, F.col("revenue")))
    share = percent(at_home, F.sum("revenue"))
    return rc.rows.agg(share.alias("revenue_share")).select(F.lit(home).alias("country"), "revenue_share")


def top_countries_excluding(rc: Receipts, home: str, n: int = 10, *, c: LineColumns = RETAIL) -> DataFrame:
    """(country, revenue) of the ``n`` best countries other than ``home``, lowest first."""
    others = rc.rows.filter(F.col(c.country) != home).groupBy(c.country)
    best = others.agg(money(F.sum("revenue")).alias("revenue")).orderBy(F.desc("revenue"), c.country).limit(n)
    return best.orderBy("revenue", F.desc(c.country))


def _visits(rc: Receipts, unit: str, c: LineColumns) -> tuple[DataFrame, Column]:
    """Rows and the count that gives invoices, or distinct (invoice, time) pairs."""
    if unit == "invoice":
        return rc.rows, rc.invoices(c)
    if unit == "invoice_ts":
        return rc.rows.select(c.invoice, c.invoice_date).distinct(), F.count("*")
    raise ValueError(f"unit is 'invoice' or 'invoice_ts', not {unit!r}")


def weekday_activity(
    rc: Receipts, *, unit: str = "invoice", fill_days: bool = False, c: LineColumns = RETAIL
) -> DataFrame:
    """(weekday, weekday_number, invoices), Monday first; ``fill_days`` adds days without sales.

    ``unit='invoice_ts'`` counts an invoice once per differing time instead of once.
    """
    rows, count = _visits(rc, unit, c)
    days = rows.groupBy(
        weekday_name(c.invoice_date).alias("weekday"), iso_weekday(c.invoice_date).alias("weekday_number")
    ).agg(count.alias("invoices"))
    if fill_days:
        names = F.array(*[F.lit(name) for name in WEEKDAYS])
        week = rc.rows.sparkSession.range(1).select(F.posexplode(names).alias("place", "weekday"))
        week = week.select("weekday", (F.col("place") + 1).alias("weekday_number"))
        days = week.join(days, ["weekday", "weekday_number"], "left")
    return days.orderBy("weekday_number")


def hour_activity(
    rc: Receipts, *, unit: str = "invoice", by_hour: bool = False, c: LineColumns = RETAIL
) -> DataFrame:
    """(hour, invoices), busiest hour first or, with ``by_hour``, in the order of the day."""
    rows, count = _visits(rc, unit, c)
    hours = rows.groupBy(F.hour(c.invoice_date).alias("hour")).agg(count.alias("invoices"))
    return hours.orderBy("hour") if by_hour else hours.orderBy(F.desc("invoices"), "hour")


def busiest(activity: DataFrame, label: str, order: str) -> DataFrame:
    """(label, invoices) of the busiest day or hour; the first in calendar order wins a tie."""
    best = F.max_by(F.struct(label, "invoices"), F.struct("invoices", -F.col(order)))
    return activity.agg(best.alias("best")).select(F.col("best")[label].alias(label), "best.invoices")


def known_unknown_revenue(rc: Receipts, *, c: LineColumns = RETAIL) -> DataFrame:
    """Invoices, revenue and revenue share with and without a known customer."""
    group = F.when(F.col(c.customer_id).isNull(), "unknown customer").otherwise("known customer")
    groups = rc.rows.groupBy(group.alias("customer_group")).agg(
        rc.invoices(c).alias("invoices"), F.sum("revenue").alias("total")
    )
    share = percent(F.col("total"), F.sum("total").over(Window.partitionBy()))
    return groups.select(
        "customer_group", "invoices", money(F.col("total")).alias("revenue"), share.alias("revenue_share")
    ).orderBy(F.desc("revenue"))


def product_summary(
    sales: DataFrame,
    products: DataFrame,
    n: int | None = None,
    *,
    by: str = "revenue",
    line_descriptions: bool = False,
    c: LineColumns = RETAIL,
) -> DataFrame:
    """Description, quantity, revenue and invoices per code, best first by ``by``.

    Descriptions come from the product table after the cut to ``n`` codes, so the long texts
    are not shuffled with the lines. With ``line_descriptions`` they are those of the sales
    lines themselves: the known one of the earliest line, the smallest at equal times.
    """
    if by not in ("revenue", "quantity"):
        raise ValueError(f"by is 'revenue' or 'quantity', not {by!r}")
    codes = sales.groupBy(c.stock_code).agg(
        F.sum(F.col(c.quantity).cast("bigint")).alias("quantity"),
        money(F.sum(c.line_total)).alias("revenue"),
        F.count_distinct(c.invoice).alias("invoices"),
    )
    order = [F.desc(by), F.asc(c.stock_code)]
    if n is not None:
        codes = codes.orderBy(*order).limit(n)
    names = products.select(c.stock_code, c.description)
    if line_descriptions:
        told = sales.filter(F.col(c.description).isNotNull()).groupBy(c.stock_code, c.description)
        told = told.agg(F.min(c.invoice_date).alias("at"))
        first = F.min(F.struct("at", F.col(c.description).alias("text")))["text"]
        names = told.groupBy(c.stock_code).agg(first.alias(c.description))
    named = codes.join(names, c.stock_code, "left")
    return named.select(c.stock_code, c.description, "quantity", "revenue", "invoices").orderBy(*order)


def top_products_ascending(sales: DataFrame, products: DataFrame, n: int = 10, *, c: LineColumns = RETAIL) -> DataFrame:
    """(stock_code, description, revenue) of the ``n`` best products, lowest first."""
    best = product_summary(sales, products, n, c=c)
    return best.select(c.stock_code, c.description, "revenue").orderBy("revenue", F.desc(c.stock_code))


def product_concentration(sales: DataFrame, cuts: Sequence[int] = (10, 100), *, c: LineColumns = RETAIL) -> DataFrame:
    """One row: percent of revenue in the best k products, for each k in ``cuts``.

    Only the best max(cuts) products are ranked; the total is a scalar beside them.
    """
    revenue = sales.groupBy(c.stock_code).agg(F.sum(c.line_total).alias("revenue"))
    total = revenue.agg(F.sum("revenue").alias("total")).scalar()
    order = [F.desc("revenue"), F.asc(c.stock_code)]
    best = revenue.orderBy(*order).limit(max(cuts))
    place = F.row_number().over(Window.orderBy(*order))
    within = lambda k: F.sum(F.when(F.col("place") <= k, F.col("revenue")))
    tops = best.withColumn("place", place).agg(*[within(k).alias(f"top_{k}") for k in cuts])
    return tops.select(*[percent(F.col(f"top_{k}"), total).alias(f"top_{k}_share") for k in cuts])
