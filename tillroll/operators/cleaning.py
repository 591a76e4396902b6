"""Cleaning of raw order lines: types, white space, duplicates, flags and subsets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import MONEY, RETAIL, SERVICE_CODES, LineColumns
from tillroll.functions.expressions import holds, strip
from tillroll.functions.staging import stage


# So many repeated fingerprints are broadcast at most; with more of them all rows are compared whole.
_REPEATED = 2_000_000


class ExpectationError(ValueError):
    """A declared expectation does not hold on every row."""


def default_types(c: LineColumns = RETAIL) -> dict[str, T.DataType]:
    return {
        c.invoice: T.StringType(),
        c.stock_code: T.StringType(),
        c.customer_id: T.IntegerType(),
        c.invoice_date: T.TimestampNTZType(),
    }


def _converted(df: DataFrame, name: str, target: T.DataType) -> Column:
    """Cast that gives NULL for what does not fit, fractional identifiers included."""
    value = F.col(name)
    source = df.schema[name].dataType
    if isinstance(target, T.IntegralType) and isinstance(source, T.StringType):
        value = value.try_cast("decimal(38,10)")
        source = T.DecimalType(38, 10)
    converted = value.try_cast(target)
    if isinstance(target, T.IntegralType) and isinstance(source, (T.FractionalType, T.DecimalType)):
        converted = F.when(value == F.floor(value), converted)
    return converted


def cast_types(df: DataFrame, types: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """Cast the named columns; a value that does not convert becomes NULL.

    Missing values stay missing (they never turn into text). Use ``cast_rejects`` for the
    number of values that were lost.
    """
    wanted = types or default_types()
    return df.withColumns({name: _converted(df, name, target) for name, target in wanted.items()})


def cast_rejects(df: DataFrame, types: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """(column_name, rejected_rows): values that ``cast_types`` cannot convert."""
    wanted = types or default_types()
    lost = [
        F.count_if(F.col(name).isNotNull() & _converted(df, name, target).isNull()).alias(name)
        for name, target in wanted.items()
    ]
    return df.agg(*lost).unpivot([], list(wanted), "column_name", "rejected_rows")


def trim_strings(df: DataFrame, columns: Sequence[str] | None = None, *, c: LineColumns = RETAIL) -> DataFrame:
    """Strip white space around the text columns; the invoice number is left as it is."""
    names = columns or [c.stock_code, c.description, c.country]
    return df.withColumns({name: strip(name) for name in names})


def drop_exact_duplicates(
    df: DataFrame, *, ignore: Sequence[str] = (), values: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Keep one of each fully equal row (missing equals missing).

    Columns named in ``ignore`` do not take part and keep their smallest value. Both forms
    are map-side combined, so a group of copies of any size reaches the shuffle as one row
    per task. The smallest of texts needs a sort of all rows; ``values`` names all values of
    an ignored text column, such as the source labels, which then travel as their place in the
    sorted list and need none. A text that is not listed fails.
    """
    if not ignore:
        return df.distinct()
    keys = [name for name in df.columns if name not in ignore]
    listed = {name: sorted(values[name]) for name in ignore if values and name in values}

    def place(name: str) -> Column:
        at = F.array_position(F.array(*[F.lit(x) for x in listed[name]]), F.col(name))
        unknown = F.raise_error(F.concat(F.lit(f"unlisted value of {name}: "), F.col(name)))
        return F.when(at == 0, unknown.cast("bigint")).otherwise(at)

    least = [F.min(place(name) if name in listed else name).alias(name) for name in ignore]
    named = lambda name: F.get(F.array(*[F.lit(x) for x in listed[name]]), F.col(name).cast("int") - 1).alias(name)
    kept = df.groupBy(*keys).agg(*least)
    return kept.select(*[named(name) if name in listed else F.col(name) for name in df.columns])


def drop_copies_of_written(df: DataFrame, **kwargs) -> DataFrame:
    """``drop_exact_duplicates`` of a written table (or a projection of one), which is read three times.

    Fingerprints are counted first. A row whose fingerprint occurs once has no copy and passes as it is; only the others
    are compared whole, so long rows are neither shuffled nor held in hash tables. Two rows that share a
    fingerprint by chance are among those others and both stay.
    """
    keys = [name for name in df.columns if name not in kwargs.get("ignore", ())]
    marked = df.withColumn("_mark", F.xxhash64(*keys))
    counted = marked.groupBy("_mark").agg(F.count("*").alias("_rows"))
    repeated = stage(counted.filter("_rows > 1").select("_mark"), "repeated")
    if repeated.count() > _REPEATED:
        return drop_exact_duplicates(df, **kwargs)
    alone = marked.join(F.broadcast(repeated), "_mark", "left_anti").drop("_mark")
    others = marked.join(F.broadcast(repeated), "_mark", "left_semi").drop("_mark")
    return alone.unionByName(drop_exact_duplicates(others, **kwargs))


def duplicates_removed(df: DataFrame, *, ignore: Sequence[str] = ()) -> DataFrame:
    """(rows_before, duplicates_removed, rows_after) of ``drop_exact_duplicates``."""
    keys = [name for name in df.columns if name not in ignore]
    copies = df.groupBy(*keys).agg(F.count("*").alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_before"),
        (F.coalesce(F.sum("copies"), F.lit(0)) - F.count("*")).alias("duplicates_removed"),
        F.count("*").alias("rows_after"),
    )


def cancelled(invoice: Column | str, *, case_insensitive: bool = False) -> Column:
    """True for invoice numbers with the cancellation prefix ``C``."""
    text = F.col(invoice) if isinstance(invoice, str) else invoice
    return holds((F.upper(text) if case_insensitive else text).startswith("C"))


def flag_cancelled(df: DataFrame, *, c: LineColumns = RETAIL, case_insensitive: bool = False) -> DataFrame:
    return df.withColumn(c.cancelled, cancelled(c.invoice, case_insensitive=case_insensitive))


def flag_negative_quantity(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    return df.withColumn(c.negative, holds(F.col(c.quantity) < 0))


def flag_service(
    df: DataFrame, codes: Sequence[str] | DataFrame = SERVICE_CODES, *, c: LineColumns = RETAIL
) -> DataFrame:
    """True for codes that are not goods; ``codes`` is a list or a one-column table."""
    if isinstance(codes, DataFrame):
        listed = codes.select(F.col(codes.columns[0]).alias(c.stock_code), F.lit(True).alias(c.service)).distinct()
        return df.join(listed, c.stock_code, "left").select(*df.columns, holds(F.col(c.service)).alias(c.service))
    return df.withColumn(c.service, holds(F.col(c.stock_code).isin(*codes)))


def derive_line_total(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    return df.withColumn(c.line_total, (F.col(c.quantity) * F.col(c.price)).cast(MONEY))


def clean_lines(
    df: DataFrame,
    *,
    c: LineColumns = RETAIL,
    codes: Sequence[str] | DataFrame = SERVICE_CODES,
    ignore: Sequence[str] = (),
    written: bool = False,
    arranged: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The whole step: types, white space, duplicates, flags, line total, service lines.

    ``written`` says that ``df`` is a written table, whose copies are found by fingerprint first. ``arranged`` deals out
    the lines that are left, before the derived columns are added.
    """
    typed = cast_types(df, default_types(c))
    drop = drop_copies_of_written if written else drop_exact_duplicates
    unique = drop(trim_strings(typed, c=c), ignore=ignore)
    if arranged:
        unique = arranged(unique)
    flagged = flag_negative_quantity(flag_cancelled(unique, c=c), c=c)
    return flag_service(derive_line_total(flagged, c=c), codes, c=c)


def is_sale(c: LineColumns = RETAIL) -> Column:
    """Ordinary sale of goods: positive quantity and price, no cancellation, no service code."""
    return (
        (F.col(c.quantity) > 0) & (F.col(c.price) > 0) & ~holds(F.col(c.cancelled)) & ~holds(F.col(c.service))
    )


def filter_sales(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    return df.filter(is_sale(c))


def filter_customer_sales(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """Sales whose customer is known; ``df`` holds sales already."""
    return df.filter(F.col(c.customer_id).isNotNull())


def sale_expectations(c: LineColumns = RETAIL) -> dict[str, Column]:
    return {
        "no_cancelled": ~F.col(c.cancelled),
        "no_service": ~F.col(c.service),
        "positive_quantity": F.col(c.quantity) > 0,
        "positive_price": F.col(c.price) > 0,
    }


def assert_expectations(
    df: DataFrame, expectations: Mapping[str, Column] | None = None, *, strict: bool = False
) -> DataFrame:
    """(expectation, failed_rows, passed) for predicates that must hold on every row.

    A predicate that is unknown on a row fails there. All are checked in one pass; ``strict``
    raises ``ExpectationError`` when any of them fails.
    """
    wanted = expectations or sale_expectations()
    failures = df.agg(*[F.count_if(~holds(test)).alias(name) for name, test in wanted.items()])
    result = failures.unpivot([], list(wanted), "expectation", "failed_rows").withColumn(
        "passed", F.col("failed_rows") == 0
    )
    if strict:
        broken = [row["expectation"] for row in result.collect() if not row["passed"]]
        if broken:
            raise ExpectationError(f"expectations not met: {', '.join(broken)}")
    return result


def watch_expectations(
    df: DataFrame, expectations: Mapping[str, Column] | None = None, *, strict: bool = False
) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``df`` whose failing rows are counted by the first action on it, and what then gives their table.

    That is ``assert_expectations`` without a scan of its own: write or stage the frame, then call for the table. With
    ``strict`` the call raises when an expectation fails; what was written meanwhile is the caller's to drop.
    """
    wanted = expectations or sale_expectations()
    seen = Observation()
    counts = [F.count_if(~holds(test)).alias(f"e{i}") for i, test in enumerate(wanted.values())]
    frame = df.observe(seen, *counts)

    def result() -> DataFrame:
        failed = seen.get
        rows = [(name, failed[f"e{i}"], failed[f"e{i}"] == 0) for i, name in enumerate(wanted)]
        broken = [name for name, _, passed in rows if not passed]
        if strict and broken:
            raise ExpectationError(f"expectations not met: {', '.join(broken)}")
        return df.sparkSession.createDataFrame(rows, "expectation string, failed_rows long, passed boolean")

    return frame, result


def cleaning_report(
    raw: DataFrame, clean: DataFrame, *, ignoring_source: bool = False, c: LineColumns = RETAIL
) -> DataFrame:
    """(metric, value): what the cleaning step kept, removed and flagged.

    ``ignoring_source`` adds ``duplicates_ignoring_source``, the lines that would go if the
    source label were not part of the duplicate key; it costs a shuffle of all clean lines.
    """
    sale = is_sale(c)
    raw_rows = raw.agg(F.count("*").alias("n")).scalar()
    more = []
    if ignoring_source:
        keys = [name for name in c.raw if name in clean.columns and name != c.source]
        unlabelled = clean.select(*keys).distinct().agg(F.count("*").alias("n")).scalar()
        more = [(raw_rows - unlabelled).alias("duplicates_ignoring_source")]
    counts = clean.agg(
        F.count("*").alias("clean_rows"),
        F.count_if(sale).alias("sales_rows"),
        F.count_if(sale & F.col(c.customer_id).isNotNull()).alias("customer_sales_rows"),
        F.count_if(c.cancelled).alias("cancelled_rows"),
        F.count_if(c.negative).alias("negative_quantity_rows"),
        F.count_if(c.service).alias("service_rows"),
    )
    report = counts.select(
        raw_rows.alias("raw_rows"), "clean_rows", "sales_rows", "customer_sales_rows",
        (raw_rows - F.col("clean_rows")).alias("duplicates_removed"),
        "cancelled_rows", "negative_quantity_rows", "service_rows", *more,
    )
    return report.unpivot([], report.columns, "metric", "value")


def preview_where(
    df: DataFrame, predicate: Column | None, columns: Sequence[str], order_by: Sequence[Column | str], n: int
) -> DataFrame:
    """First ``n`` rows that satisfy a predicate, in a stated order."""
    rows = df if predicate is None else df.filter(predicate)
    return rows.orderBy(*order_by).limit(n).select(*columns)


def service_code_list(df: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """Distinct (stock_code, description) among the service lines, sorted."""
    listed = df.filter(F.col(c.service)).select(c.stock_code, c.description).distinct()
    return listed.orderBy(c.stock_code, F.col(c.description).asc_nulls_last())
