"""Which columns depend on which keys, and where they do not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import RETAIL, LineColumns
from tillroll.functions.expressions import minutes_between
from tillroll.operators.profiling import describe_numeric


def dependants_per_key(df: DataFrame, key: str, dependants: Mapping[str, str]) -> DataFrame:
    """Distinct dependants of each key, as columns named by ``dependants`` (name -> column).

    Equal combinations are folded first, so that the several distinct counts expand the
    combinations and not the lines.
    """
    combinations = df.filter(F.col(key).isNotNull()).select(key, *dict.fromkeys(dependants.values())).distinct()
    return combinations.groupBy(key).agg(*[F.count_distinct(x).alias(name) for name, x in dependants.items()])


def fd_check(df: DataFrame, key: str, dependants: Mapping[str, str]) -> DataFrame:
    """(dependant, max_values, violating_keys): how far each column is from depending on ``key``."""
    counts = dependants_per_key(df, key, dependants)
    names = list(dependants)
    summary = counts.agg(
        *[
            F.struct(
                F.lit(x).alias("dependant"),
                F.max(x).alias("max_values"),
                F.count_if(F.col(x) > 1).alias("violating_keys"),
            ).alias(x)
            for x in names
        ]
    )
    return summary.select(F.inline(F.array(*names)))


def invoice_fd_check(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    return fd_check(
        df, c.invoice, {"customers": c.customer_id, "dates": c.invoice_date, "countries": c.country}
    )


def multi_date_rows(df: DataFrame, n: int | None = 30, *, c: LineColumns = RETAIL) -> DataFrame:
    """Distinct (invoice, timestamp) of the invoices with more than one timestamp, sorted."""
    spread = invoice_time_spread(df, c=c).select(c.invoice)
    pairs = df.select(c.invoice, c.invoice_date).distinct()
    rows = pairs.join(spread, c.invoice, "left_semi")
    if n is None:
        return rows
    return rows.orderBy(c.invoice, c.invoice_date).limit(n)


def invoice_time_spread(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """(invoice, min, max, diff_minutes) of the invoices whose lines differ in time."""
    bounds = df.groupBy(c.invoice).agg(F.min(c.invoice_date).alias("min"), F.max(c.invoice_date).alias("max"))
    return bounds.filter(F.col("max") > F.col("min")).withColumn("diff_minutes", minutes_between("min", "max"))


def invoice_time_spread_describe(
    df: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75), *, c: LineColumns = RETAIL
) -> DataFrame:
    return describe_numeric(invoice_time_spread(df, c=c), ["diff_minutes"], probabilities)


def invoice_time_spread_top(df: DataFrame, n: int = 10, *, c: LineColumns = RETAIL) -> DataFrame:
    return invoice_time_spread(df, c=c).orderBy(F.desc("diff_minutes"), c.invoice).limit(n)


def customer_country_check(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """(customers_with_several, max_countries) over the known customers."""
    per_customer = dependants_per_key(df, c.customer_id, {"countries": c.country})
    return per_customer.agg(
        F.count_if(F.col("countries") > 1).alias("customers_with_several"),
        F.max("countries").alias("max_countries"),
    )


def _descriptions_per_code(df: DataFrame, c: LineColumns) -> DataFrame:
    described = df.filter(F.col(c.description).isNotNull())
    return dependants_per_key(described, c.stock_code, {"descriptions": c.description})


def product_description_check(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """(codes_with_several, max_descriptions) over the described codes."""
    return _descriptions_per_code(df, c).agg(
        F.count_if(F.col("descriptions") > 1).alias("codes_with_several"),
        F.max("descriptions").alias("max_descriptions"),
    )


def product_description_top(df: DataFrame, n: int = 10, *, c: LineColumns = RETAIL) -> DataFrame:
    return _descriptions_per_code(df, c).orderBy(F.desc("descriptions"), c.stock_code).limit(n)


def description_variants(df: DataFrame, code: str, *, c: LineColumns = RETAIL) -> DataFrame:
    """Distinct descriptions of one code, sorted."""
    rows = df.filter(F.col(c.stock_code) == code).select(c.stock_code, c.description).distinct()
    return rows.orderBy(F.col(c.description).asc_nulls_last())
