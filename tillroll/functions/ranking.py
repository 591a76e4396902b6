"""Global order without a single-task sort: dense row numbers and exact quantiles."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from tillroll.functions.staging import stage

# monotonically_increasing_id keeps the partition above bit 33 and the row below it.
_ROW_BITS = 33

# So many rows of a table that was counted are sorted in one task.
_SORTED_ROWS = 500_000

#: Column that places a row within the order of its table.
PLACE = "_at"

# Buckets per doubling of a value's size in exact_quantiles, and parts of a bucket that is sorted.
_BUCKETS_PER_OCTAVE = 512
_PARTS = 1024


def range_partition(df: DataFrame, order_by: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """Range partitioning that also splits a run of rows equal in all of ``order_by``.

    The input partition of a row is the last key, so copies from different inputs may part.
    """
    marked = df.withColumn("_input", F.spark_partition_id())
    keys = [*order_by, "_input"]
    ranged = marked.repartitionByRange(partitions, *keys) if partitions else marked.repartitionByRange(*keys)
    return ranged.drop("_input")


def dense_sequence(
    df: DataFrame,
    order_by: Sequence[Column],
    name: str,
    *,
    keep: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Append ``name`` = 1..n in the global order ``order_by``; ``keep`` names the columns to return.

    Rows are range partitioned and sorted per partition, then written once; the size of
    each partition gives the offset of the next. Only one row per partition is broadcast.
    """
    kept = list(keep or df.columns)
    placed = stage(in_places(df, order_by, partitions).select(*kept, PLACE), "sequence")
    return number_places(placed, name, keep=kept)


def in_places(df: DataFrame, order_by: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """Rows in the global order ``order_by`` with their ``PLACE``, which holds for the table they are written to."""
    ordered = range_partition(df, order_by, partitions).sortWithinPartitions(*order_by)
    return ordered.withColumn(PLACE, F.monotonically_increasing_id())


def sorted_parts(rows: int, df: DataFrame) -> int | None:
    """Partitions in which to sort counted rows; None, for Spark's own choice, where they are no more than cores."""
    parts = -(-rows // _SORTED_ROWS)
    return parts if parts > df.sparkSession.sparkContext.defaultParallelism else None


def number_places(placed: DataFrame, name: str, *, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``name`` = 1..n of all rows of a written table of ``in_places``."""
    kept = list(keep)
    part = F.shiftright(PLACE, _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    row = F.col(PLACE) - F.shiftleft(part, _ROW_BITS)
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.select(*kept, (F.col("_offset") + row + 1).cast("bigint").alias(name))


# Items of a quantile sketch, and the share of ranks by which it may be off (nearly always less).
_SKETCH_ITEMS = 4096
_RANK_ERROR = 0.0015


@dataclasses.dataclass(frozen=True)
class Sketched:
    """What one scan tells of numeric columns: rows with a value, brackets of wanted ranks, other aggregates."""

    rows: dict[str, int]
    brackets: dict[str, list[tuple[float, float]]]
    other: Row


def sketch_brackets(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], *others: Column,
    error: float = _RANK_ERROR, items: int = _SKETCH_ITEMS,
) -> Sketched:
    """One aggregate over ``df``: a mergeable quantile sketch per column, read at both sides of every wanted rank.

    A bracket runs from the value ``error`` of all ranks below a wanted one to the value as far above; brackets that
    meet become one. ``others`` are aggregated in the same scan. Only these few numbers come to the driver.
    """
    value = {x: _number(df, x) for x in columns}
    folded = df.agg(
        *[F.count(value[x]).alias(f"n|{x}") for x in columns],
        *[F.kll_sketch_agg_double(value[x], F.lit(items)).alias(f"s|{x}") for x in columns],
        *others,
    )

    # Ranks are read a few margins off on both sides, as a sketch takes them before the number of rows is known.
    margins = [error, 8 * error, 64 * error, 1.0]
    ranks = [min(1.0, max(0.0, float(p) + sign * m)) for m in margins for p in probabilities for sign in (-1, 1)]
    edges = lambda x: F.when(
        F.col(f"n|{x}") > 0, F.kll_sketch_get_quantile_double(f"s|{x}", F.array(*[F.lit(r) for r in ranks]))
    )
    names = [name for name in folded.columns if not name.startswith("s|")]
    row = folded.select(*[F.col(f"`{name}`") for name in names], *[edges(x).alias(f"e|{x}") for x in columns]).first()
    brackets = {}
    for x in columns:
        held, n, width = row[f"e|{x}"] or [], row[f"n|{x}"], 2 * len(probabilities)
        # Two ranks more: those between which a value is interpolated.
        at = next((i for i, m in enumerate(margins) if n and m >= error + 2 / n), len(margins) - 1)
        held = held[at * width : (at + 1) * width]
        brackets[x] = _merged(sorted(zip(held[::2], held[1::2], strict=True)))
    return Sketched({x: row[f"n|{x}"] for x in columns}, brackets, row)


def _number(df: DataFrame, name: str) -> Column:
    """A column as double, NaN as missing."""
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None))


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _slotted(df: DataFrame, columns: Sequence[str], brackets: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(field, slot, part, value, n): equal rows of the brackets counted, all between two brackets as one.

    Slots count up: 0 below the first bracket, 1 in it, 2 above it and so on. A bracket is cut into equal parts.
    """

    def slot(i: int, x: str) -> str:
        cases = " ".join(
            f"when v{i} < double('{lo!r}') then {2 * k} when v{i} <= double('{hi!r}') then {2 * k + 1}"
            for k, (lo, hi) in enumerate(brackets[x])
        )
        return f"case {cases} when v{i} is not null then {2 * len(brackets[x])} end" if cases else "cast(null as int)"

    def row(i: int, x: str) -> Column:
        parts = " ".join(
            f"when s{i} = {2 * k + 1} then cast(least(floor((v{i} - double('{lo!r}'))"
            f" / (double('{hi!r}') - double('{lo!r}')) * {_PARTS}), {_PARTS} - 1) as int)"
            for k, (lo, hi) in enumerate(brackets[x]) if lo < hi
        )
        return F.struct(
            F.lit(x).alias("field"), F.col(f"s{i}").alias("slot"),
            F.expr(f"case {parts} else 0 end" if parts else "0").alias("part"),
            F.expr(f"if(s{i} % 2 = 1, v{i}, null)").alias("value"),
        )

    values = df.select(*[_number(df, x).alias(f"v{i}") for i, x in enumerate(columns)])
    slots = values.select("*", *[F.expr(slot(i, x)).alias(f"s{i}") for i, x in enumerate(columns)])
    rows = slots.select(F.inline(F.array(*[row(i, x) for i, x in enumerate(columns)]))).filter("slot is not null")
    return rows.groupBy("field", "slot", "part", "value").agg(F.count("*").alias("n"))


def bracketed_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], known: Sketched | None = None
) -> DataFrame:
    """Linearly interpolated quantiles as rows (field, p, value); missing values and NaN are left out.

    Two scans. The first sketches every column and brackets the wanted ranks (``known``, if that has been done). The
    second counts the values inside the brackets, equal ones before the shuffle, and all others as one number; what it
    leaves, a share of the rows, is staged. Should a rank lie outside its bracket after all, the bracket is widened and
    the scan repeated. The values of a bracket are ordered within its parts, equal stretches between its ends, so no
    task sorts a bracket.
    """
    spark, error = df.sparkSession, _RANK_ERROR
    found = known or sketch_brackets(df, columns, probabilities)
    brackets, open_, done, targets = dict(found.brackets), [x for x in columns if found.rows[x]], [], []
    while open_:
        # The size of each slot is added up while the counts are written.
        seen, at = Observation(), [(x, k) for x in open_ for k in range(2 * len(brackets[x]) + 1)]
        size = lambda x, k: F.sum(F.when((F.col("field") == x) & (F.col("slot") == k), F.col("n")))
        sums = [size(x, k).alias(f"n{i}") for i, (x, k) in enumerate(at)]
        counted = stage(_slotted(df, open_, {x: brackets[x] for x in open_}).observe(seen, *sums), "brackets")
        sizes: dict[str, dict[int, int]] = {x: {} for x in open_}
        for i, (x, k) in enumerate(at):
            if seen.get[f"n{i}"]:
                sizes[x][k] = seen.get[f"n{i}"]
        missed = []
        for x in open_:
            wanted, n = _targets(x, probabilities, sizes[x], found.rows[x])
            if wanted is None:
                missed.append(x)
            else:
                targets += wanted
        done.append(counted.filter(F.col("field").isin([x for x in open_ if x not in missed]) & (F.col("slot") % 2 == 1)))
        error *= 8
        if missed:
            again = sketch_brackets(df, missed, probabilities, error=min(error, 1.0))
            brackets |= again.brackets
        open_ = missed
    if not targets:
        return spark.createDataFrame([], "field string, p double, value double")
    wanted = spark.createDataFrame(targets, "field string, slot int, p double, position double, low long, high long")
    return spark.sql(
        f"""
        with counted as (select * from {{counted}}),
        parts as (
          select field, slot, part, sum(size) over (partition by field, slot order by part) - size as before
          from (select field, slot, part, sum(n) as size from counted group by field, slot, part)),
        ordered as (
          select c.field, c.slot, c.value, c.n,
            p.before + sum(c.n) over (partition by c.field, c.slot, c.part order by c.value) - c.n as skip
          from counted c join parts p on p.field = c.field and p.slot = c.slot and p.part = c.part),
        hits as (
          select /*+ broadcast(w) */ o.field, w.p, w.position, o.value,
            w.low between o.skip and o.skip + o.n - 1 as is_low, w.high between o.skip and o.skip + o.n - 1 as is_high
          from ordered o join {{wanted}} w on w.field = o.field and w.slot = o.slot)
        select field, p,
          max(case when is_low then value end)
            + (max(case when is_high then value end) - max(case when is_low then value end))
            * max(position - floor(position)) as value
        from hits where is_low or is_high
        group by field, p
        """,
        counted=reduce(DataFrame.unionByName, done), wanted=wanted,
    )


def _targets(field: str, probabilities: Sequence[float], sizes: dict[int, int], rows: int):
    """Per probability (field, slot, p, position, low, high), ranks from the begin of the slot; None if one lies outside."""
    before, at = {}, 0
    for slot in sorted(sizes):
        before[slot], at = at, at + sizes[slot]
    out = []
    for p in probabilities:
        position = float(p) * (rows - 1)
        low, high = math.floor(position), math.ceil(position)
        slot = next((s for s, b in before.items() if s % 2 and b <= low and high < b + sizes[s]), None)
        if slot is None:
            return None, at
        out.append((field, slot, float(p), position, low - before[slot], high - before[slot]))
    return out, at


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], *, weight: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles as rows (field, p, value); missing values are left out.

    ``weight`` names a column that tells how many equal rows each row stands for; without it see
    ``bracketed_quantiles``.

    With weights, a first pass counts rows per logarithmic bucket, which leaves a bounded table whose running
    totals tell the bucket of each wanted rank. A second pass keeps the rows of those buckets
    alone and counts equal values (a hot value folds before the shuffle). A bucket is cut into
    equal parts between its smallest and largest value, so a column whose values all lie close
    together is spread as well, and values are sorted within a part. Broadcast are the buckets
    of the wanted ranks, at most two per column and probability, and their parts.
    """
    if weight is None:
        return bracketed_quantiles(df, columns, probabilities)
    # The bucket never decreases as the value grows and is known for every value, infinity included.
    size = f"floor(least(log2(abs(cast(value as double)) * 10000 + 1) * {_BUCKETS_PER_OCTAVE}, 1e9d))"
    values = (
        df.select(*columns, F.col(weight).cast("bigint").alias("_weight"))
        .unpivot("_weight", list(columns), "field", "value")
        .filter("value is not null and not isnan(cast(value as double))")
        .selectExpr(
            "field", "value", "_weight",
            f"coalesce(cast(signum(cast(value as double)) * {size} as bigint), 0L) as bucket",
        )
    )
    wanted = ", ".join(f"{float(p)!r}d" for p in probabilities)
    return df.sparkSession.sql(
        f"""
        with lines as (select * from {{values}}),
        filled as (
          select field, bucket, sum(_weight) as size, min(cast(value as double)) as lo,
            max(cast(value as double)) as hi
          from lines group by field, bucket),
        placed as (
          select *, sum(size) over (partition by field order by bucket) - size as start,
            sum(size) over (partition by field) - 1 as last
          from filled),
        ranks as (
          select field, bucket, lo, hi, start, size, p, p * last as position, floor(p * last) as low,
            ceil(p * last) as high
          from placed lateral view explode(array({wanted})) as p),
        targets as (
          select field, bucket, start, p, position, low, high from ranks
          where low between start and start + size - 1 or high between start and start + size - 1),
        bounds as (
          select field, bucket, any_value(lo) as lo, any_value(hi) as hi
          from ranks where low between start and start + size - 1 or high between start and start + size - 1
          group by field, bucket),
        counted as (
          select /*+ broadcast(bounds) */ field, bucket, value,
            if(hi > lo, cast(least(floor((cast(value as double) - lo) / (hi - lo) * {_PARTS}), {_PARTS} - 1) as int), 0)
              as part,
            sum(_weight) as n
          from lines join bounds using (field, bucket)
          group by field, bucket, value, lo, hi),
        parts as (
          select field, bucket, part, sum(size) over (partition by field, bucket order by part) - size as before
          from (select field, bucket, part, sum(n) as size from counted group by field, bucket, part)),
        ordered as (
          select /*+ broadcast(parts) */ field, bucket, cast(value as double) as value, n,
            before + sum(n) over (partition by field, bucket, part order by value) - n as skip
          from counted join parts using (field, bucket, part)),
        hits as (
          select /*+ broadcast(targets) */ field, p, position, value,
            low between start + skip and start + skip + n - 1 as is_low,
            high between start + skip and start + skip + n - 1 as is_high
          from ordered join targets using (field, bucket))
        select field, p,
          max(case when is_low then value end)
            + (max(case when is_high then value end) - max(case when is_low then value end))
            * max(position - floor(position)) as value
        from hits where is_low or is_high
        group by field, p
        """,
        values=values,
    )


def quantile_name(p: float) -> str:
    """p25, p99, p99_9."""
    return "p" + f"{p * 100:g}".replace(".", "_")


def quantiles_wide(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], *, approx: bool = False
) -> DataFrame:
    """One row per field and one column per probability; ``approx`` uses a bounded sketch."""
    if approx:
        sketch = [
            F.percentile_approx(F.col(c).cast("double"), [float(p) for p in probabilities], 10000).alias(c)
            for c in columns
        ]
        rows = df.agg(*sketch).unpivot([], list(columns), "field", "sketch")
        return rows.select(
            "field", *[F.col("sketch")[i].alias(quantile_name(p)) for i, p in enumerate(probabilities)]
        )
    return spread_quantiles(exact_quantiles(df, columns, probabilities), probabilities)


def spread_quantiles(long: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Rows (field, p, value) as one row per field and one column per probability."""
    at = [f"max(case when p = {float(p)!r}d then value end) as {quantile_name(p)}" for p in probabilities]
    return long.groupBy("field").agg(*[F.expr(text) for text in at])
