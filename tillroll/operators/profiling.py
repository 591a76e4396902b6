"""Profiles of a table: shape, missing values, frequencies, distributions, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import RETAIL, LineColumns
from tillroll.functions.expressions import percent
from tillroll.functions.ranking import bracketed_quantiles, quantiles_wide, sketch_brackets, spread_quantiles
from tillroll.operators.cleaning import cancelled

# Copies of one duplicate group that a single task writes out at once.
_COPIES_PER_CHUNK = 1_000_000


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))


def profile_schema(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, non_null) of every column, counted in one pass."""
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    places = F.create_map(*[F.lit(x) for i, f in enumerate(df.schema, 1) for x in (f.name, i)])
    counts = df.agg(*[F.count(name).alias(name) for name in df.columns])
    rows = counts.unpivot([], df.columns, "column_name", "non_null")
    return rows.select(
        places[F.col("column_name")].alias("position"), "column_name",
        types[F.col("column_name")].alias("data_type"), "non_null",
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, *, approx: bool = False) -> DataFrame:
    """(column_name, distinct_values) per column, most first, missing values left out.

    Exact counts run one narrow aggregate per column over a pruned scan. Several
    ``count(distinct)`` in one aggregate would copy every row once per column instead.
    """
    names = list(columns or df.columns)
    if approx:
        sketches = df.agg(*[F.approx_count_distinct(name).alias(name) for name in names])
        return sketches.unpivot([], names, "column_name", "distinct_values").orderBy(
            F.desc("distinct_values"), "column_name"
        )

    def one(name: str) -> DataFrame:
        values = df.select(name).filter(F.col(name).isNotNull()).distinct()
        return values.agg(F.count("*").alias("distinct_values")).select(
            F.lit(name).alias("column_name"), "distinct_values"
        )

    counts = reduce(DataFrame.unionByName, [one(name) for name in names])
    return counts.orderBy(F.desc("distinct_values"), "column_name")


def profile_main_info(df: DataFrame, *, c: LineColumns = RETAIL, approx: bool = False) -> DataFrame:
    """One row: rows and distinct invoices, products, customers and countries."""
    wanted = {
        "invoices": c.invoice, "products": c.stock_code, "customers": c.customer_id, "countries": c.country,
    }
    counts = distinct_counts(df, list(wanted.values()), approx=approx)
    rows = df.agg(F.count("*").alias("distinct_values")).select(F.lit("*").alias("column_name"), "distinct_values")
    pick = lambda name: F.max(F.when(F.col("column_name") == name, F.col("distinct_values")))
    return rows.unionByName(counts).agg(
        pick("*").alias("rows"), *[pick(name).alias(label) for label, name in wanted.items()]
    )


def profile_time_range(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    return df.agg(F.min(c.invoice_date).alias("first_date"), F.max(c.invoice_date).alias("last_date"))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """(value, rows) by falling frequency, ties by value; missing values are left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    ordered = counts.agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.asc("value"))
    return ordered if n is None else ordered.limit(n)


def missing_profile(df: DataFrame, *, only_missing: bool = False) -> DataFrame:
    """(column_name, missing_count, missing_percent), most missing first.

    ``only_missing`` keeps the columns that miss something, fewest first.
    """
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(name).isNull()).alias(name) for name in df.columns]
    )
    rows = counts.unpivot(["_rows"], df.columns, "column_name", "missing_count").select(
        "column_name", "missing_count",
        percent(F.col("missing_count"), F.col("_rows"), 4).alias("missing_percent"),
    )
    if only_missing:
        return rows.filter(F.col("missing_count") > 0).orderBy("missing_count", "column_name")
    return rows.orderBy(F.desc("missing_count"), "column_name")


def describe_numeric(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    *,
    approx: bool = False,
) -> DataFrame:
    """One row per column: count, mean, sample deviation, minimum, percentiles, maximum.

    Missing values and NaN are left out.
    """
    one_pass = {"count": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    numbers = df.select(*[F.nanvl(x, F.lit(None)).alias(x) if x in floating else F.col(x) for x in columns])
    stats = [
        F.expr(f"cast({function}(`{x}`) as {'bigint' if stat == 'count' else 'double'}) as `{x}|{stat}`")
        for x in columns
        for stat, function in one_pass.items()
    ]
    if approx:
        cells = ", ".join(f"'{x}', " + ", ".join(f"`{x}|{stat}`" for stat in one_pass) for x in columns)
        rows = numbers.agg(*stats).selectExpr(f"stack({len(columns)}, {cells}) as (field, {', '.join(one_pass)})")
        quantiles = quantiles_wide(numbers, columns, probabilities, approx=True)
    else:  # the scan that brackets the quantiles gives the other figures too
        found = sketch_brackets(numbers, columns, probabilities, *stats)
        held = [(x, *[found.other[f"{x}|{stat}"] for stat in one_pass]) for x in columns]
        rows = df.sparkSession.createDataFrame(held, "field string, count long, mean double, std double, min double, max double")
        quantiles = spread_quantiles(bracketed_quantiles(numbers, columns, probabilities, found), probabilities)
    names = [name for name in quantiles.columns if name != "field"]
    joined = rows.join(F.broadcast(quantiles), "field", "left")
    return joined.select("field", "count", "mean", "std", "min", *names, "max")


def quantile_table(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.5, 0.9, 0.95, 0.99, 0.999),
    *,
    approx: bool = False,
) -> DataFrame:
    return quantiles_wide(df, columns, probabilities, approx=approx)


def duplicate_stats(df: DataFrame) -> DataFrame:
    """(duplicate_rows, duplicate_percent): rows that repeat an earlier one."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    totals = groups.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"), F.count("*").alias("kept"))
    repeats = F.col("rows") - F.col("kept")
    return totals.select(repeats.alias("duplicate_rows"), percent(repeats, F.col("rows")).alias("duplicate_percent"))


def duplicate_rows(df: DataFrame, n: int | None = 10) -> DataFrame:
    """Every member of the duplicate groups, or the first ``n`` in column order.

    A group travels as one row with its size. Its copies are written out only at the end: at
    most ``n`` of them, or, without a limit, in chunks that are spread over the tasks first.
    """
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_copies")).filter(F.col("_copies") > 1)
    order = [F.col(name).asc_nulls_last() for name in df.columns]
    if n is not None:
        copies = F.explode(F.sequence(F.lit(1), F.least(F.col("_copies"), F.lit(n))))
        return groups.orderBy(*order).limit(n).select(*df.columns, copies.alias("_copy")).orderBy(*order).limit(
            n
        ).drop("_copy")
    size = F.lit(_COPIES_PER_CHUNK)
    chunks = F.explode(F.sequence(F.lit(0), F.expr(f"(_copies - 1) div {_COPIES_PER_CHUNK}")))
    spread = groups.select("*", chunks.alias("_chunk")).repartition(*df.columns, "_chunk")
    here = F.least(size, F.col("_copies") - F.col("_chunk") * size)
    return spread.select(*df.columns, F.explode(F.sequence(F.lit(1), here)).alias("_copy")).drop("_copy")


def cancellation_stats(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """(cancelled_rows, cancelled_invoices, cancelled_percent) by the invoice prefix."""
    per_invoice = df.groupBy(c.invoice).agg(F.count("*").alias("_rows")).withColumn("_c", cancelled(c.invoice))
    rows = F.coalesce(F.sum(F.when(F.col("_c"), F.col("_rows"))), F.lit(0))
    return per_invoice.agg(
        rows.alias("cancelled_rows"),
        F.count_if("_c").alias("cancelled_invoices"),
        percent(rows, F.sum("_rows")).alias("cancelled_percent"),
    )


def suspicious_values(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """One row of counts: signs of quantity and price, missing customer and description."""
    return df.agg(
        F.count_if(F.col(c.quantity) < 0).alias("quantity_below_zero"),
        F.count_if(F.col(c.quantity) == 0).alias("quantity_equal_zero"),
        F.count_if(F.col(c.price) < 0).alias("price_below_zero"),
        F.count_if(F.col(c.price) == 0).alias("price_equal_zero"),
        F.count_if(F.col(c.customer_id).isNull()).alias("missing_customer_id"),
        F.count_if(F.col(c.description).isNull()).alias("missing_description"),
    )


def crosstab_flags(df: DataFrame, down: Column, across: Column, name: str = "flag") -> DataFrame:
    """Two-way counts of two flags: rows ``name`` false/true, columns ``false`` and ``true``."""
    flags = df.select(down.alias(name), across.alias("_across"))
    return flags.groupBy(name).agg(
        F.count_if(~F.col("_across")).alias("false"), F.count_if("_across").alias("true")
    )


def distinct_by_group(df: DataFrame, group: str, value: str, name: str, n: int | None = None) -> DataFrame:
    """Distinct ``value`` per ``group``, most first, ties by group."""
    counts = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(value).alias(name))
    ordered = counts.orderBy(F.desc(name), group)
    return ordered if n is None else ordered.limit(n)


def top_n_rows(
    df: DataFrame, measure: str, n: int, columns: Sequence[str], tiebreak: Sequence[Column | str]
) -> DataFrame:
    """``n`` largest rows by a measure, ties in a stated order."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *tiebreak).limit(n).select(*columns)


def named_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """(metric, value): rows that meet each condition, counted in one pass."""
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in conditions.items()])
    return counts.unpivot([], list(conditions), "metric", "value")
