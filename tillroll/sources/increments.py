"""Loads that join published tables: only the new lines are cleaned of copies, numbered and written.

Next to the four tables a store keeps what the next load needs, in tables that merge: a fingerprint per line, headers and
descriptions counted per load, and the last key. A load drops lines that an earlier one brought, numbers the others
after the last key and adds its own folders; order items, fingerprints, headers and descriptions of earlier loads are
neither sorted nor written again. Orders, products and customers are small next to the lines and made anew from the
counts, since a new line can change which description, time or customer comes first.

All is published together (see ``sources.versions``); a load that fails leaves the former publication as it is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import LOAD_ORDER, RETAIL, LineColumns
from tillroll.functions.staging import COMPRESSION, delete_folder, owned_stages, stage
from tillroll.operators import checks, entities
from tillroll.sources import versions

#: Tables of a store besides the entities: what later loads need.
STATE = ("fingerprints", "headers", "descriptions", "last_key")

#: Tables to which a load adds; of the others a publication names one load.
GROWING = ("order_items", "fingerprints", "headers", "descriptions")

#: A list of this many repeated fingerprints may be broadcast.
REPEATED = 2_000_000


def fingerprint(columns: list[str]) -> Column:
    """128 bits that tell rows with different values apart, missing ones from empty ones included."""
    parts = [
        F.coalesce(F.concat(F.octet_length(F.col(x).cast("string")).cast("string"), F.lit(":"), F.col(x).cast("string")), F.lit("-"))
        for x in columns
    ]
    return F.unhex(F.left(F.sha2(F.concat(*parts).cast("binary"), 256), F.lit(32)))


def _stored(spark: SparkSession, folder: str) -> tuple[int, str, dict[str, list[str]], dict[str, DataFrame]]:
    seq, version = versions.new_version(spark, folder)
    _, _, loads = versions.current(spark, folder)
    return seq, version, loads, versions.published(spark, folder) if loads else {}


def _one_of_each(fresh: DataFrame) -> DataFrame:
    """Of the written lines that share a fingerprint the smallest; fingerprints are counted first.

    Lines whose fingerprint occurs once pass as they are, so they are neither shuffled nor sorted whole.
    """
    counted = fresh.groupBy("_fp").agg(F.count("*").alias("n"))
    repeated = stage(counted.filter("n > 1").select("_fp"), "repeated")
    n = repeated.count()
    if not n:
        return fresh
    small = F.broadcast if n <= REPEATED else lambda df: df
    alone = fresh.join(small(repeated), "_fp", "left_anti").select(*fresh.columns)
    others = fresh.join(small(repeated), "_fp", "left_semi")
    row = F.min(F.struct(*(name for name in fresh.columns if name != "_fp"))).alias("row")
    smallest = others.groupBy("_fp").agg(row).select("row.*", "_fp")
    return stage(alone.unionByName(smallest), "fresh")


def append_lines(
    spark: SparkSession, folder: str, clean: DataFrame, *, ignore_source: bool = False, c: LineColumns = RETAIL
) -> str:
    """Join clean lines (of ``cleaning.clean_lines``) to the tables published in ``folder``; the first load makes them.

    Lines that an earlier load has brought are left out, with ``ignore_source`` also those of another source, so a
    source that is delivered twice changes nothing. Old keys stay, new lines get the next ones in their own order.
    Every constraint is checked before the publication; of the order items only the new ones are read for it. One load at
    a time: of two at once, the one that is published later counts. Returns the version.
    """
    seq, version, loads, old = _stored(spark, folder)
    path = lambda table: versions.load_path(folder, table, version)
    seen = [name for name in c.raw if name in clean.columns and not (ignore_source and name == c.source)]
    done = []

    def add(table: str, frame: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
        """Write this load's part of a table, its row rules counted on the way."""
        done.append(path(table))
        watched, counted = checks.watched(frame, rules or {})
        watched.write.option("compression", COMPRESSION).parquet(path(table))
        checks.raise_broken({name: n for name, n in counted().items() if name != "rows"})
        return spark.read.schema(frame.schema).parquet(path(table))

    def merged(table: str, new: DataFrame) -> DataFrame:
        return old[table].unionByName(new) if table in old else new

    try:
        with owned_stages(spark):
            marked = clean.withColumn("_fp", fingerprint(seen))
            if "fingerprints" in old:
                marked = marked.join(old["fingerprints"].withColumnRenamed("fp", "_fp"), "_fp", "left_anti")
            fresh = stage(marked, "fresh")
            if ignore_source:
                fresh = _one_of_each(fresh)
            lines = fresh.drop("_fp")
            add("fingerprints", fresh.select(F.col("_fp").alias("fp")))
            headers = merged("headers", add("headers", entities.header_counts(lines, c=c)))
            described = merged("descriptions", add("descriptions", entities.description_counts(lines, c=c)))
            last = old["last_key"].first()["last_key"] if old else 0
            numbered = entities.fact_order_items(lines, c=c)
            shifted = numbered.withColumn("order_item_id", F.col("order_item_id") + F.lit(last))
            items = add("order_items", shifted, checks.row_rules("order_items"))
            orders = add("orders", entities.orders_of(headers, c=c), checks.row_rules("orders"))
            counts = described.groupBy(c.stock_code, c.description).agg(F.sum("n").alias("n"))
            products = add("products", entities.products_of(counts, c=c), checks.row_rules("products"))
            known = headers.filter(F.col(c.customer_id).isNotNull()).select(c.customer_id).distinct()
            customers = add("customers", known, checks.row_rules("customers"))
            add("last_key", items.agg(F.coalesce(F.max("order_item_id"), F.lit(last)).alias("last_key")))
            made = {"customers": customers, "products": products, "orders": orders, "order_items": items}
            broken = {row["constraint"]: row["violations"] for row in checks.key_violations(made).collect()}
            broken["keys not after the last"] = items.filter(F.col("order_item_id") <= last).count()
            checks.raise_broken(broken)
    except BaseException:
        for place in done:
            delete_folder(spark, place)
        raise
    names = {name: [*(loads.get(name, []) if name in GROWING else []), version] for name in (*LOAD_ORDER, *STATE)}
    versions.announce(spark, folder, seq, version, names)
    return version


def entities_of(spark: SparkSession, folder: str, version: str | None = None) -> dict[str, DataFrame]:
    """The four entities of a publication, without the tables that loads keep."""
    held = versions.published(spark, folder, version)
    return {name: held[name] for name in LOAD_ORDER}


def load_report(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, loads, customers, products, orders, order_items) of the last publication."""
    seq, _, loads = versions.current(spark, folder)
    tables = entities_of(spark, folder)
    counts = [tables[name].agg(F.count("*").alias("n")).scalar().alias(name) for name in LOAD_ORDER]
    return spark.range(1).select(
        F.lit(seq).cast("long").alias("seq"), F.lit(len(loads["order_items"])).alias("loads"), *counts
    )
