"""The four normalised entities: customers, products, orders and order items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import RETAIL, LineColumns
from tillroll.functions.ranking import dense_sequence, in_places, number_places, sorted_parts
from tillroll.functions.staging import stage


def dim_customers(clean: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    return clean.filter(F.col(c.customer_id).isNotNull()).select(c.customer_id).distinct()


def description_counts(clean: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """(stock_code, description, n): what products are made of; counts of several loads add up."""
    return clean.groupBy(c.stock_code, c.description).agg(F.count("*").alias("n"))


def products_of(counted: DataFrame, *, c: LineColumns = RETAIL, keep_empty: bool = False) -> DataFrame:
    """Products of counted descriptions (see ``dim_products``)."""
    described = F.col(c.description).isNotNull()
    if not keep_empty:
        described = described & (F.col(c.description) != "")
    choice = F.when(described, F.struct((-F.col("n")).alias("rank"), F.col(c.description).alias("text")))
    return counted.groupBy(c.stock_code).agg(F.min(choice)["text"].alias(c.description))


def dim_products(clean: DataFrame, *, c: LineColumns = RETAIL, keep_empty: bool = False) -> DataFrame:
    """Every stock code with its most frequent description, ties to the alphabetically first.

    Missing descriptions never win, nor do empty ones unless ``keep_empty``. Lines are counted
    per (code, description) first, so a code that holds most lines is folded before it is
    gathered.
    """
    return products_of(description_counts(clean, c=c), c=c, keep_empty=keep_empty)


def header_counts(clean: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """(invoice, customer, time, country, cancelled, n): what orders are made of.

    A hash aggregate with a count that is used (a plain distinct would be optimised away); it leaves about one row per
    invoice. Counts of several loads may stand side by side.
    """
    folded = clean.groupBy(c.invoice, c.customer_id, c.invoice_date, c.country, c.cancelled)
    return folded.agg(F.count("*").alias("n")).filter("n > 0")


def fact_orders(clean: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """One row per invoice: earliest time, first known customer, first country, cancellation.

    Lines have no order of their own here, so "first" is the earliest line and, among lines
    of the same time, the smallest value. Equal header combinations are folded first.
    """
    return orders_of(header_counts(clean, c=c), c=c)


def orders_of(headers: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """Orders of folded headers (see ``fact_orders``)."""
    first = lambda name: F.min(
        F.when(F.col(name).isNotNull(), F.struct(F.col(c.invoice_date).alias("at"), F.col(name).alias("value")))
    )["value"].alias(name)
    return headers.groupBy(c.invoice).agg(
        first(c.customer_id),
        F.min(c.invoice_date).alias(c.invoice_date),
        first(c.country),
        first(c.cancelled),
    )


def line_order(c: LineColumns = RETAIL) -> list[str]:
    """Columns whose joint order numbers the lines: by time, then invoice, then the rest."""
    return [
        c.invoice_date, c.invoice, c.stock_code, c.description, c.quantity, c.price, c.customer_id, c.country,
        c.source,
    ]


def fact_order_items(
    clean: DataFrame, *, c: LineColumns = RETAIL, item_id: str = "order_item_id", partitions: int | None = None
) -> DataFrame:
    """Line projection with a dense surrogate key 1..n over the full row order.

    The key depends on the rows alone, not on partitioning, so a second run gives the same.
    """
    keys = [name for name in line_order(c) if name in clean.columns]
    wanted = [c.invoice, c.stock_code, c.quantity, c.price, c.line_total]
    lines = clean.select(*dict.fromkeys(keys + wanted))
    order = [F.col(name).asc_nulls_last() for name in keys]
    numbered = dense_sequence(lines, order, item_id, keep=wanted, partitions=partitions)
    return numbered.select(item_id, *wanted)


def lines_in_places(lines: DataFrame, rows: int, *, c: LineColumns = RETAIL) -> DataFrame:
    """Lines in the order that numbers them; once written, ``items_in_places`` numbers them without another sort.

    ``rows`` is about their number, so that no task sorts more than memory holds.
    """
    order = [F.col(name).asc_nulls_last() for name in line_order(c) if name in lines.columns]
    return in_places(lines, order, sorted_parts(rows, lines))


def items_in_places(placed: DataFrame, *, c: LineColumns = RETAIL, item_id: str = "order_item_id") -> DataFrame:
    """The rows of ``fact_order_items``, of clean lines that were written in places."""
    wanted = [c.invoice, c.stock_code, c.quantity, c.price, c.line_total]
    return number_places(placed, item_id, keep=wanted).select(item_id, *wanted)


def normalise(clean: DataFrame, *, c: LineColumns = RETAIL, staged: bool = False) -> dict[str, DataFrame]:
    """All four entities; ``clean`` should be a staged table, since each entity scans it.

    ``staged`` writes each entity to the shared folder, for use by several checks and views;
    the order items are read from the sequence that numbers them and not written again.
    """
    made = {
        "customers": dim_customers(clean, c=c),
        "products": dim_products(clean, c=c),
        "orders": fact_orders(clean, c=c),
        "order_items": fact_order_items(clean, c=c),
    }
    if staged:
        made = {name: frame if name == "order_items" else stage(frame, name) for name, frame in made.items()}
    return made
