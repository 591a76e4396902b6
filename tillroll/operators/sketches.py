"""Stored distinct counts: a sketch of customers and invoices per month, which merge to any range of months.

A distinct count cannot be added up over months, a sketch can: a month's row has fixed size, is made once and never read
from the lines again. Counts are exact up to ``2 ** precision`` different values and beyond that off by a relative
standard error of ``1 / sqrt(2 ** precision)``, 0.4 % by default (see ``sketch_error``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import RETAIL, LineColumns
from tillroll.functions.expressions import money, month_of, quotient
from tillroll.operators.views import Receipts

#: Log2 of the values that a sketch holds exactly.
PRECISION = 16


def sketch_error(precision: int = PRECISION) -> float:
    """Relative standard error of a count beyond ``2 ** precision`` values."""
    return (2.0**precision) ** -0.5


def month_sketches(rc: Receipts, *, precision: int = PRECISION, c: LineColumns = RETAIL) -> DataFrame:
    """(month, customers, invoices, quantity, revenue): sketches and sums of each month, to be stored."""
    return rc.rows.groupBy(month_of(c.invoice_date).alias("month")).agg(
        F.theta_sketch_agg(c.customer_id, precision).alias("customers"),
        F.theta_sketch_agg(c.invoice, precision).alias("invoices"),
        F.sum("quantity").alias("quantity"),
        F.sum("revenue").alias("revenue"),
    )


def merge_sketches(*stored: DataFrame, precision: int = PRECISION) -> DataFrame:
    """One row per month of several stored tables, such as those of two loads.

    Customers and invoices that both know count once; sums add up, so the loads must not share lines.
    """
    return reduce(DataFrame.unionByName, stored).groupBy("month").agg(
        F.theta_union_agg("customers", precision).alias("customers"),
        F.theta_union_agg("invoices", precision).alias("invoices"),
        F.sum("quantity").alias("quantity"),
        F.sum("revenue").alias("revenue"),
    )


def _between(first: str | None, last: str | None) -> Column:
    inside = F.lit(True)
    if first:
        inside = inside & (F.col("month") >= F.lit(first).cast("date"))
    if last:
        inside = inside & (F.col("month") <= F.lit(last).cast("date"))
    return inside


def range_metrics(
    stored: DataFrame, first: str | None = None, last: str | None = None, *, precision: int = PRECISION
) -> DataFrame:
    """One row: first and last month, customers, invoices, revenue, average invoice of a range of months."""
    held = stored.filter(_between(first, last)).agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.theta_union_agg("customers", precision).alias("c"), F.theta_union_agg("invoices", precision).alias("i"),
        F.sum("revenue").alias("total"),
    )
    return held.select(
        "first_month", "last_month", F.theta_sketch_estimate("c").alias("customers"),
        F.theta_sketch_estimate("i").alias("invoices"), money(F.col("total")).alias("revenue"),
        quotient(F.col("total"), F.theta_sketch_estimate("i")).alias("average_invoice"),
    )


def period_metrics(stored: DataFrame, period: str = "quarter", *, precision: int = PRECISION) -> DataFrame:
    """(period, customers, invoices, revenue) of calendar quarters or years, from the months' rows alone."""
    held = stored.groupBy(F.trunc("month", period).alias("period")).agg(
        F.theta_union_agg("customers", precision).alias("c"), F.theta_union_agg("invoices", precision).alias("i"),
        F.sum("revenue").alias("total"),
    )
    return held.select(
        "period", F.theta_sketch_estimate("c").alias("customers"), F.theta_sketch_estimate("i").alias("invoices"),
        money(F.col("total")).alias("revenue"),
    ).orderBy("period")


def returning_customers(
    stored: DataFrame, earlier: tuple[str, str], later: tuple[str, str], *, precision: int = PRECISION
) -> DataFrame:
    """One row: customers of two ranges of months, and those who are in both."""
    of = lambda span: F.theta_union_agg(F.when(_between(*span), F.col("customers")), precision)
    held = stored.agg(of(earlier).alias("a"), of(later).alias("b"))
    return held.select(
        F.theta_sketch_estimate("a").alias("earlier_customers"),
        F.theta_sketch_estimate("b").alias("later_customers"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("returning_customers"),
    )
