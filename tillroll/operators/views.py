"""Views over the entities: sales lines, receipts, invoice and month summaries."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import LOAD_ORDER, RETAIL, SERVICE_CODES, LineColumns
from tillroll.functions.expressions import money, month_of, quotient


# Marks the invoice column of lines whose customer, time and country are those of their order.
_OF_ORDER = {"tillroll.header": "order"}


def v_sales(
    order_items: DataFrame, orders: DataFrame, products: DataFrame, *, codes: Sequence[str] = SERVICE_CODES,
    orders_last: bool = False,
) -> DataFrame:
    """Sales lines with the customer, time and country of their order and the product text.

    Both joins are plain equi-joins: small parents are broadcast by their measured size, and
    an invoice or code that holds most lines is split by the adaptive skew join.

    With ``orders_last`` lines meet their products first, so the headers of orders are not shuffled to the products,
    and the lines of an invoice come out side by side: once written, they fold before the shuffle. Tables that are
    bucketed by invoice are better joined the other way.
    """
    goods = order_items.filter(
        (F.col("quantity") > 0) & (F.col("price") > 0) & ~F.col("stock_code").isin(*codes)
    )
    standing = orders.filter(~F.col("is_cancelled")).drop("is_cancelled")
    parents = [(standing, "invoice"), (products, "stock_code")]
    for parent, key in reversed(parents) if orders_last else parents:
        goods = goods.join(parent, key)
    return goods.select(
        "order_item_id", F.col("invoice").alias("invoice", metadata=_OF_ORDER), "customer_id", "invoice_date", "country",
        "stock_code", "description", "quantity", "price", "line_total",
    )


def v_customer_sales(sales: DataFrame) -> DataFrame:
    return sales.filter(F.col("customer_id").isNotNull())


@dataclasses.dataclass(frozen=True)
class Receipts:
    """Sales lines folded to (invoice, customer, time, country): ``rows`` with lines, quantity and revenue.

    ``by_invoice`` says that an invoice is one row, so that rows count as invoices. Only
    ``invoice_receipts`` sets it, from the one source for which it holds.
    """

    rows: DataFrame
    by_invoice: bool = False

    def invoices(self, c: LineColumns = RETAIL) -> Column:
        """Number of invoices, as an aggregate."""
        return F.count("*") if self.by_invoice else F.count_distinct(c.invoice)

    def known(self, c: LineColumns = RETAIL) -> Receipts:
        """The receipts of known customers."""
        return dataclasses.replace(self, rows=self.rows.filter(F.col(c.customer_id).isNotNull()))

    def stored(self, store: Callable[[DataFrame], DataFrame]) -> Receipts:
        """The same receipts, staged or cached by ``store``."""
        return dataclasses.replace(self, rows=store(self.rows))


def receipt_columns(c: LineColumns = RETAIL) -> list[str]:
    """The columns of lines that receipts are made of."""
    return [c.invoice, c.customer_id, c.invoice_date, c.country, c.quantity, c.line_total]


def receipts(sales: DataFrame, *, c: LineColumns = RETAIL) -> Receipts:
    """Receipts of lines with a time, customer and country of their own.

    Every invoice-level metric starts here: the fold happens before the shuffle, and what
    follows works on about one row per invoice. An invoice has one row per differing
    customer, time or country.
    """
    rows = sales.groupBy(c.invoice, c.customer_id, c.invoice_date, c.country).agg(
        F.count("*").alias("lines"),
        F.sum(F.col(c.quantity).cast("bigint")).alias("quantity"),
        F.sum(c.line_total).alias("revenue"),
    )
    return Receipts(rows)


def invoice_receipts(sales: DataFrame, *, c: LineColumns = RETAIL) -> Receipts:
    """Receipts of ``v_sales``, whose lines have the customer, time and country of their order.

    That makes one row per invoice. Lines that do not come from ``v_sales`` are refused: it marks its invoice column, and
    the mark stays through filters, stages and files.
    """
    marks = [f.metadata for f in sales.schema if f.name == c.invoice]
    if not marks or any(marks[0].get(name) != value for name, value in _OF_ORDER.items()):
        raise ValueError("invoice receipts are made of v_sales; use receipts for other lines")
    return dataclasses.replace(receipts(sales, c=c), by_invoice=True)


def v_invoice_summary(rc: Receipts, *, c: LineColumns = RETAIL) -> DataFrame:
    """(invoice, customer_id, invoice_date, country, items_count, revenue) from receipts."""
    if rc.by_invoice:
        return rc.rows.select(
            c.invoice, c.customer_id, F.col(c.invoice_date).alias("invoice_date"), F.col(c.country).alias("country"),
            F.col("quantity").alias("items_count"), money(F.col("revenue")).alias("revenue"),
        )
    return rc.rows.groupBy(c.invoice, c.customer_id).agg(
        F.min(c.invoice_date).alias("invoice_date"),
        F.min(c.country).alias("country"),
        F.sum("quantity").alias("items_count"),
        money(F.sum("revenue")).alias("revenue"),
    )


def v_monthly_metrics(rc: Receipts, *, c: LineColumns = RETAIL) -> DataFrame:
    """(month, invoices, customers, revenue, average_invoice) from receipts."""
    months = rc.rows.groupBy(month_of(c.invoice_date).alias("month")).agg(
        rc.invoices(c).alias("invoices"),
        F.count_distinct(c.customer_id).alias("customers"),
        F.sum("revenue").alias("total"),
    )
    return months.select(
        "month", "invoices", "customers", money(F.col("total")).alias("revenue"),
        quotient(F.col("total"), F.col("invoices")).alias("average_invoice"),
    )


def register_tables(entities: Mapping[str, DataFrame], *, prefix: str = "") -> list[str]:
    """Expose the four entities as temporary views, ready for SQL."""
    for name in LOAD_ORDER:
        entities[name].createOrReplaceTempView(prefix + name)
    return [prefix + name for name in LOAD_ORDER]


def register_views(
    entities: Mapping[str, DataFrame], *, prefix: str = "", codes: Sequence[str] = SERVICE_CODES
) -> list[str]:
    """Expose the four views over the entities under their SQL names."""
    sales = v_sales(entities["order_items"], entities["orders"], entities["products"], codes=codes)
    rc = invoice_receipts(sales)
    views = {
        "v_sales": sales,
        "v_customer_sales": v_customer_sales(sales),
        "v_invoice_summary": v_invoice_summary(rc),
        "v_monthly_metrics": v_monthly_metrics(rc),
    }
    for name, frame in views.items():
        frame.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
