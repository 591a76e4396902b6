"""Sinks: stages, CSV exports, published tables and the storage layout of lines."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import LOAD_ORDER, RETAIL, SERVICE_CODES, LineColumns
from tillroll.functions.expressions import month_of
from tillroll.functions.ranking import range_partition
from tillroll.functions.staging import COMPRESSION, delete_folder, folder_exists, move_folder
from tillroll.operators import checks
from tillroll.sources.readers import CSV_OPTIONS


def sink_stage(df: DataFrame, path: str, *, mode: str = "errorifexists") -> str:
    """Persist one step of the flow as Parquet and return its path."""
    df.write.mode(mode).parquet(path)
    return path


def sink_csv(frames: Mapping[str, DataFrame], folder: str, *, mode: str = "errorifexists") -> dict[str, str]:
    """One CSV folder per frame, without an index column."""
    paths = {}
    for name, frame in frames.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        frame.write.options(**CSV_OPTIONS).mode(mode).csv(paths[name])
    return paths


def sink_csv_tables(entities: Mapping[str, DataFrame], folder: str, **kwargs) -> dict[str, str]:
    """Export the four entities, parents first."""
    return sink_csv({name: entities[name] for name in LOAD_ORDER}, folder, **kwargs)


def sink_csv_summaries(
    monthly: DataFrame, segments: DataFrame, countries: DataFrame, products: DataFrame, folder: str, **kwargs
) -> dict[str, str]:
    """Export the four summary reports."""
    return sink_csv(
        {
            "monthly_sales": monthly,
            "rfm_segments": segments,
            "country_summary": countries,
            "product_summary": products,
        },
        folder,
        **kwargs,
    )


def published_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(load_order, table_name, rows_count) of the written tables."""
    counted = [
        tables[name].agg(F.count("*").alias("rows_count")).select(
            F.lit(step).alias("load_order"), F.lit(name).alias("table_name"), "rows_count"
        )
        for step, name in enumerate(LOAD_ORDER, start=1)
    ]
    return reduce(DataFrame.unionByName, counted)


def load_checked(entities: Mapping[str, DataFrame], paths: Mapping[str, str], *, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Write the entities to ``paths``, parents first, and check every constraint on the way.

    Rules on single rows are counted while a table is written, so an entity is read once. Keys and references are checked
    on the columns of the written tables. A broken constraint raises ``ConstraintError`` after all that; the caller
    decides what becomes of the files.
    """
    spark = entities[LOAD_ORDER[0]].sparkSession
    broken: dict[str, int] = {}
    written = {}
    for name in LOAD_ORDER:
        frame, counted = checks.watched(entities[name], checks.row_rules(name))
        packed = {"compression": COMPRESSION} if fmt == "parquet" else {}
        frame.write.options(**packed).format(fmt).save(paths[name])
        broken |= {rule: n for rule, n in counted().items() if rule != "rows"}
        written[name] = spark.read.format(fmt).schema(entities[name].schema).load(paths[name])
    broken |= {row["constraint"]: row["violations"] for row in checks.key_violations(written).collect()}
    checks.raise_broken(broken)
    return written


def publish_tables(
    entities: Mapping[str, DataFrame], folder: str, *, fmt: str = "parquet", mode: str = "errorifexists"
) -> DataFrame:
    """Check every constraint and publish the entities, parents first, as files below ``folder``.

    The tables are written once, next to their place and under checks (see ``load_checked``), and moved there when all
    constraints hold; else nothing is published. Moving four folders is not one step: readers who must never see
    new parents with old children use ``sources.versions``. ``mode`` is ``errorifexists`` or ``overwrite``. Returns
    (load_order, table_name, rows_count) as read back from the published tables.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode is 'errorifexists' or 'overwrite', not {mode!r}")
    spark, base = entities[LOAD_ORDER[0]].sparkSession, folder.rstrip("/")
    there = [name for name in LOAD_ORDER if folder_exists(spark, f"{base}/{name}")]
    if there and mode == "errorifexists":
        raise FileExistsError(f"{base} has {', '.join(there)} already")
    loading = f"{base}/_loading-{uuid.uuid4().hex}"
    try:
        load_checked(entities, {name: f"{loading}/{name}" for name in LOAD_ORDER}, fmt=fmt)
        for name in LOAD_ORDER:
            if name in there:
                delete_folder(spark, f"{base}/{name}")
            move_folder(spark, f"{loading}/{name}", f"{base}/{name}")
    finally:
        delete_folder(spark, loading)
    written = {
        name: spark.read.format(fmt).schema(entities[name].schema).load(f"{base}/{name}") for name in LOAD_ORDER
    }
    return published_counts(written)


def view_texts(schema: str, codes: Sequence[str]) -> dict[str, str]:
    """The four views over the named tables, in the order they build on each other.

    The summaries fold the lines of ``v_sales`` to receipts first, as the operators do: such a line has the customer, time
    and country of its order, so a receipt is an invoice.
    """
    listed = ", ".join("'" + code.replace("'", "''") + "'" for code in codes)
    folded = f"""(select invoice, customer_id, invoice_date, country, sum(cast(quantity as bigint)) as items,
              sum(line_total) as amount from {schema}.v_sales group by all) as receipts"""
    return {
        "v_sales": f"""
            select i.order_item_id, o.invoice, o.customer_id, o.invoice_date, o.country, i.stock_code, p.description,
              i.quantity, i.price, i.line_total
            from {schema}.order_items i
            join {schema}.products p on p.stock_code = i.stock_code
            join {schema}.orders o on o.invoice = i.invoice
            where not o.is_cancelled and i.quantity > 0 and i.price > 0 and i.stock_code not in ({listed})""",
        "v_customer_sales": f"select * from {schema}.v_sales where customer_id is not null",
        "v_invoice_summary": f"""
            select invoice, customer_id, invoice_date, country, items as items_count,
              cast(round(amount, 2) as decimal(38,2)) as revenue
            from {folded}""",
        "v_monthly_metrics": f"""
            select month, invoices, customers, cast(round(amount, 2) as decimal(38,2)) as revenue,
              round(cast(amount / invoices as decimal(38,10)), 2) as average_invoice
            from (select trunc(invoice_date, 'MM') as month, count(*) as invoices,
                count(distinct customer_id) as customers, sum(amount) as amount
              from {folded} group by all)""",
    }


def publish_catalog(
    entities: Mapping[str, DataFrame], schema: str, folder: str, *, codes: Sequence[str] = SERVICE_CODES
) -> list[str]:
    """Check every constraint, then save the entities as named tables with statistics and views over them.

    The tables are external, below ``folder``; tables and views live in ``schema`` of the session's
    catalog, which is made if it is missing. Returns the names, tables first.
    """
    publish_tables(entities, folder)
    spark = entities[LOAD_ORDER[0]].sparkSession
    spark.sql(f"create schema if not exists {schema}")
    for name in LOAD_ORDER:
        path = f"{folder.rstrip('/')}/{name}"
        spark.catalog.createTable(f"{schema}.{name}", path, source="parquet", schema=entities[name].schema)
        analyze_table(spark, f"{schema}.{name}")
    texts = view_texts(schema, codes)
    for name, text in texts.items():
        spark.sql(f"create or replace view {schema}.{name} as {text}")
    return [f"{schema}.{name}" for name in (*LOAD_ORDER, *texts)]


def layout_tables(
    lines: DataFrame,
    path: str,
    *,
    c: LineColumns = RETAIL,
    partitions: int | None = None,
    mode: str = "errorifexists",
) -> str:
    """Store lines for pruning by date, country, customer, product and cancellation.

    One folder per month, files range partitioned by month, country and invoice, rows sorted
    inside so that Parquet row-group bounds prune the other filters. A month, country or
    invoice that holds most rows is spread over many range partitions.
    """
    keys = ["order_month", c.country, c.invoice]
    monthly = lines.withColumn("order_month", month_of(c.invoice_date))
    ranged = range_partition(monthly, keys, partitions)
    order = ["order_month", c.country, c.cancelled, c.customer_id, c.invoice_date, c.stock_code]
    present = [name for name in order if name in monthly.columns]
    ranged.sortWithinPartitions(*present).write.mode(mode).partitionBy("order_month").parquet(path)
    return path


# So many rows of a bucket are sorted and written by one task.
_FILE_ROWS = 500_000

#: Columns by which the tables are looked up, besides those they are bucketed by.
LOOKUPS = {"orders": ("customer_id", "invoice"), "order_items": ("stock_code", "invoice")}


def bucket_tables(
    entities: Mapping[str, DataFrame], schema: str, folder: str, *, buckets: int = 64, block_bytes: int | None = None
) -> list[str]:
    """Save the entities as named tables laid out for their joins and lookups; returns the names.

    Orders and order items are bucketed by invoice, so their join needs no shuffle on either side. Within a bucket rows are
    sorted by the first lookup column (customer, stock code), so that row groups, of ``block_bytes`` if given, hold
    narrow ranges of it; Parquet bloom filters tell which row groups lack a looked-up value. An invoice is in one bucket
    however many lines it has: for data in which one invoice dominates, ``layout_tables`` spreads it.

    A large bucket is several files: the shuffle has a multiple of ``buckets`` partitions, so each of them lies within one
    bucket, and tasks grow in number with the rows, which are counted first.
    """
    spark, base = entities[LOAD_ORDER[0]].sparkSession, folder.rstrip("/")
    spark.sql(f"create schema if not exists {schema}")
    for name in LOAD_ORDER:
        frame = entities[name]
        if name in LOOKUPS:
            files = max(1, -(-frame.count() // (buckets * _FILE_ROWS)))
            writer = frame.repartition(buckets * files, "invoice").write.bucketBy(buckets, "invoice").sortBy(LOOKUPS[name][0])
            for column in LOOKUPS[name]:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            if block_bytes:
                writer = writer.option("parquet.block.size", str(block_bytes))
        else:
            writer = frame.write
        writer.option("path", f"{base}/{name}").format("parquet").saveAsTable(f"{schema}.{name}")
    return [f"{schema}.{name}" for name in LOAD_ORDER]


def analyze_table(spark, table: str) -> None:
    """Refresh the statistics of a catalog table for the cost-based optimiser."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
