"""Customers: repeat purchases, cohorts and recency/frequency/monetary segments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import RETAIL, LineColumns
from tillroll.functions.expressions import money, month_of, percent, quotient
from tillroll.functions.ranking import quantile_name, quantiles_wide
from tillroll.functions.staging import stage
from tillroll.operators.profiling import describe_numeric
from tillroll.operators.views import Receipts

# Labels of the order-count groups and their bounds (both included).
ORDER_GROUPS = (("1", 1, 1), ("2-5", 2, 5), ("6-10", 6, 10), (">10", 11, None))

# Segment, bounds of the recency score, bounds of the frequency score. The first
# line that fits names the segment.
SEGMENT_RULES = (
    ("Champions", (4, 4), (4, 4)),
    ("Loyal customers", (3, 4), (3, 4)),
    ("Potential loyalists", (3, 4), (2, 2)),
    ("New customers", (4, 4), (1, 1)),
    ("Promising", (3, 3), (1, 1)),
    ("At risk", (1, 2), (3, 4)),
    ("Hibernating", (1, 4), (1, 4)),
)

# Recommended action per segment.
SEGMENT_ACTIONS = (
    ("Champions", "Персональные предложения и программа лояльности"),
    ("Loyal customers", "Поддерживать частоту покупок и предлагать сопутствующие товары"),
    ("At risk", "Реактивационная кампания и персональная скидка"),
    ("Potential loyalists", "Стимулировать вторую и последующие покупки"),
    ("New customers", "Помочь совершить повторную покупку"),
    ("Hibernating", "Выделить ценных клиентов и не тратить бюджет на всю группу"),
)

QUARTILES = (0.25, 0.5, 0.75)

# Months in one whole number of a month set: all bits but the sign.
_MONTHS_A_WORD = 63


def orders_per_customer(rc: Receipts, *, c: LineColumns = RETAIL) -> DataFrame:
    """(customer_id, orders_count): distinct invoices per known customer, from receipts."""
    return rc.known(c).rows.groupBy(c.customer_id).agg(rc.invoices(c).alias("orders_count"))


def repeat_rate(orders: DataFrame) -> DataFrame:
    """One row: customers, one-time and repeat customers, percent that repeat."""
    repeat = F.count_if(F.col("orders_count") >= 2)
    return orders.agg(
        F.count("*").alias("customers"),
        F.count_if(F.col("orders_count") == 1).alias("one_time_customers"),
        repeat.alias("repeat_customers"),
        percent(repeat, F.count("*")).alias("repeat_customer_rate"),
    )


def orders_distribution(
    orders: DataFrame, probabilities: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99), *, approx: bool = False
) -> DataFrame:
    return describe_numeric(orders, ["orders_count"], probabilities, approx=approx)


def orders_histogram(orders: DataFrame, *, upper: float = 0.99, bins: int = 30) -> DataFrame:
    """(bin, bin_from, bin_to, customers) of order counts up to the quantile ``upper``.

    Equal-width bins from the smallest to the largest kept value; the last one is closed and
    empty ones are listed. Bin numbers come from whole-number division, so a value on an edge
    always opens the bin to its right.

    After customers are counted per number of orders, few rows are left: k different numbers
    need at least k * k / 2 invoices. The windows over the whole table run on those rows.
    """
    sizes = orders.groupBy("orders_count").agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    limit = F.percentile("orders_count", F.lit(upper), F.col("n")).over(everything)
    kept = sizes.withColumn("limit", limit).filter(F.col("orders_count") <= F.col("limit"))
    ends = kept.select(
        "orders_count", "n", F.min("orders_count").over(everything).alias("lo"),
        F.max("orders_count").over(everything).alias("hi"),
    )
    place = f"if(hi = lo, {bins // 2}, least((orders_count - lo) * {bins} div nullif(hi - lo, 0), {bins - 1})) + 1"
    filled = ends.groupBy("lo", "hi", F.expr(f"cast({place} as int)").alias("bin")).agg(F.sum("n").alias("n"))
    bars = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    frame = filled.groupBy("lo", "hi").agg(bars.alias("found"))
    return frame.select(
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "found",
        F.expr("if(hi = lo, lo - 0.5d, cast(lo as double))").alias("low"),
        F.expr(f"if(hi = lo, 1d, cast(hi - lo as double)) / {bins}").alias("width"),
    ).selectExpr(
        "bin", "low + width * (bin - 1) as bin_from", "low + width * bin as bin_to",
        "coalesce(found[bin], 0L) as customers",
    ).orderBy("bin")


def order_groups(
    orders: DataFrame, groups: Sequence[tuple[str, int, int | None]] = ORDER_GROUPS, *, fill: bool = False
) -> DataFrame:
    """(orders_group, customers, customer_share) by number of orders, smallest group first.

    A group without customers is left out unless ``fill``.
    """
    count = F.col("orders_count")
    inside = lambda lo, hi: (count >= lo) if hi is None else count.between(lo, hi)
    counted = orders.agg(
        F.count("*").alias("total"), *[F.count_if(inside(lo, hi)).alias(label) for label, lo, hi in groups]
    )
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"), F.lit(label).alias("orders_group"), F.col(f"`{label}`").alias("customers")
            )
            for i, (label, _, _) in enumerate(groups)
        ]
    )
    rows = counted.select("total", F.inline(listed))
    if not fill:
        rows = rows.filter(F.col("customers") > 0)
    share = percent(F.col("customers"), F.col("total")).alias("customer_share")
    return rows.orderBy("place").select("orders_group", "customers", share)


def month_sets(
    rc: Receipts, first: str | None = None, last: str | None = None, *, c: LineColumns = RETAIL
) -> DataFrame:
    """(customer_id, first_month, months): the months in which each known customer bought, as a set of bits.

    Bit k of ``months``, 63 in each of its whole numbers, stands for the k-th month after ``first_month``, the month of
    ``first`` (the earliest sale, unless given) and the same in every row. Receipts after ``last`` or before ``first`` do not
    count. A customer is one row of fixed size from the first task on, whatever they bought; sets of equal bounds
    merge with ``merge_month_sets``.
    """
    known = rc.known(c).rows
    if first is None or last is None:
        found = known.agg(F.min(c.invoice_date).alias("a"), F.max(c.invoice_date).alias("b")).first()
        first, last = first or found["a"], last or found["b"]
    start, end = (F.lit(x).cast("date") for x in (first, last))
    begin = month_of(start)
    # Months are counted by the calendar alone, so the number of words is known before the receipts are read.
    span = 0 if first is None or last is None else _month_number(last) - _month_number(first)
    words = max(span, 0) // _MONTHS_A_WORD + 1
    month = F.year(c.invoice_date) * 12 + F.month(c.invoice_date) - (F.year(begin) * 12 + F.month(begin))
    placed = known.select(c.customer_id, month.cast("int").alias("_m")).filter(
        F.col("_m").between(0, max(span, 0)) & F.lit(span >= 0)
    )
    bit = lambda w: F.expr(f"if(_m div {_MONTHS_A_WORD} = {w}, shiftleft(1L, _m % {_MONTHS_A_WORD}), 0L)")
    held = placed.groupBy(c.customer_id).agg(*[F.bit_or(bit(w)).alias(f"_w{w}") for w in range(words)])
    return held.select(
        c.customer_id, begin.alias("first_month"), F.array(*[F.col(f"_w{w}") for w in range(words)]).alias("months")
    )


def _month_number(day) -> int:
    year, month = (int(x) for x in str(day).split("-")[:2])
    return year * 12 + month


def merge_month_sets(*sets: DataFrame, c: LineColumns = RETAIL) -> DataFrame:
    """One row per customer of several ``month_sets`` with the same first month; the longest set gives the width."""
    keys = [c.customer_id, "first_month"]
    words = reduce(DataFrame.unionByName, sets).select(*keys, F.posexplode("months").alias("w", "bits"))
    whole = words.groupBy(*keys, "w").agg(F.bit_or("bits").alias("bits")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("held")
    )
    size = F.array_max(F.map_keys("held"))
    padded = F.transform(F.sequence(F.lit(0), size), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("bigint")))
    return whole.select(*keys, padded.alias("months"))


def activity_of_sets(sets: DataFrame, *, c: LineColumns = RETAIL) -> DataFrame:
    """(customer_id, cohort_month, order_month, month_number) of ``month_sets``, one row per active month.

    A customer's months come out of their own row, so neither a join nor a second shuffle is needed.
    """
    n = _MONTHS_A_WORD
    # The first month: zeros below the lowest bit of the first word that has one.
    place = "array_position(transform(months, x -> x > 0), true) - 1"
    word = sets.filter("exists(months, x -> x > 0)").withColumn("_w", F.expr(f"cast({place} as int)"))
    first = word.withColumn("_from", F.expr(f"_w * {n} + bit_count(~months[_w] & (months[_w] - 1))"))
    each = first.select(c.customer_id, "first_month", "_from", F.posexplode("months").alias("_at", "_bits"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_bit"))
    rows = each.filter(F.expr("shiftright(_bits, _bit) & 1L = 1L")).withColumn("_k", F.col("_at") * n + F.col("_bit"))
    return rows.select(
        c.customer_id,
        F.add_months("first_month", F.col("_from")).alias("cohort_month"),
        F.add_months("first_month", F.col("_k")).alias("order_month"),
        (F.col("_k") - F.col("_from")).cast("int").alias("month_number"),
    )


def cohort_activity(rc: Receipts, *, c: LineColumns = RETAIL) -> DataFrame:
    """(customer_id, cohort_month, order_month, month_number), one row per active month.

    Receipts fold to one set of months per customer before the shuffle.
    """
    return activity_of_sets(month_sets(rc, c=c), c=c)


def cohort_sizes(activity: DataFrame) -> DataFrame:
    """(cohort_month, month_number, cohort_size, active_customers) of every cohort and month.

    Everyone is active in month 0 of their cohort, so the size is read off that row.
    """
    active = activity.groupBy("cohort_month", "month_number").agg(F.count("*").alias("active_customers"))
    start = F.max(F.when(F.col("month_number") == 0, F.col("active_customers")))
    return active.withColumn("cohort_size", start.over(Window.partitionBy("cohort_month")))


def cohort_maps(activity: DataFrame) -> DataFrame:
    """(cohort_month, active): a map from month number to active customers, one row per cohort."""
    counted = activity.groupBy("cohort_month", "month_number").agg(F.count("*").alias("n"))
    return counted.groupBy("cohort_month").agg(
        F.map_from_entries(F.collect_list(F.struct("month_number", "n"))).alias("active")
    )


def cohort_retention(
    activity: DataFrame, first: str | None = None, last: str | None = None, months: tuple[int, int] = (1, 6)
) -> DataFrame:
    """Retention in percent for cohorts first..last (both included) and a range of months."""
    rows = cohort_sizes(activity).filter(F.col("month_number").between(*months))
    if first:
        rows = rows.filter(F.col("cohort_month") >= F.lit(first).cast("date"))
    if last:
        rows = rows.filter(F.col("cohort_month") <= F.lit(last).cast("date"))
    rate = percent(F.col("active_customers"), F.col("cohort_size")).alias("retention_rate")
    return rows.select("cohort_month", "month_number", "cohort_size", "active_customers", rate).orderBy(
        "cohort_month", "month_number"
    )


def retention_matrix(
    activity: DataFrame, months: Sequence[int] | None = None, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Cohorts down, months across (``month_<k>``), percent; no activity gives NULL.

    Each cohort is one map from month to customers, which a projection spreads over the columns. Without ``months`` they
    run from month 0 to the last month of any cohort; then the maps, a row per cohort, are staged and that one number
    is read from them.
    """
    maps = cohort_maps(activity)
    if months is None:
        maps = stage(maps, "cohort-maps")
        widest = maps.agg(F.max(F.array_max(F.map_keys("active"))).alias("k")).first()["k"]
        months = range(0 if widest is None else widest + 1)
    if first:
        maps = maps.filter(F.col("cohort_month") >= F.lit(first).cast("date"))
    if last:
        maps = maps.filter(F.col("cohort_month") <= F.lit(last).cast("date"))
    rate = F.transform_values("active", lambda _, n: percent(n, F.try_element_at("active", F.lit(0))))
    rates = maps.select("cohort_month", rate.alias("rates"))
    return rates.selectExpr("cohort_month", *[f"try_element_at(rates, {k}) as month_{k}" for k in months]).orderBy("cohort_month")


def retention_summary(
    activity: DataFrame, months: Sequence[int] = (1, 3, 6), first: str | None = None, last: str | None = None
) -> DataFrame:
    return retention_matrix(activity, months, first, last)


def retention_summary_mean(
    activity: DataFrame, months: Sequence[int] = (1, 3, 6), first: str | None = None, last: str | None = None
) -> DataFrame:
    """One row: mean over the cohorts of each month's retention; missing values do not count."""
    rows = cohort_sizes(activity)
    if first:
        rows = rows.filter(F.col("cohort_month") >= F.lit(first).cast("date"))
    if last:
        rows = rows.filter(F.col("cohort_month") <= F.lit(last).cast("date"))
    rate = F.col("active_customers").cast("double") * 100 / F.col("cohort_size")
    mean = lambda k: F.round(F.avg(F.when(F.col("month_number") == k, rate)).cast("decimal(38,10)"), 2)
    return rows.agg(*[mean(k).alias(f"month_{k}") for k in months])


def rfm_customer(
    rc: Receipts, *, recency: str = "calendar", c: LineColumns = RETAIL
) -> DataFrame:
    """(customer_id, recency, frequency, monetary), counted from one day after the last sale.

    ``recency='calendar'`` is the difference of the dates, ``'elapsed'`` the number of full
    24-hour periods.
    """
    known = rc.known(c).rows
    latest = known.agg(F.max(c.invoice_date).alias("t")).scalar()
    stats = known.groupBy(c.customer_id).agg(
        F.max(c.invoice_date).alias("last"),
        rc.invoices(c).alias("frequency"),
        F.sum("revenue").alias("monetary"),
    )
    if recency == "calendar":
        days = F.date_diff(F.date_add(F.to_date(latest), 1), F.to_date("last"))
    elif recency == "elapsed":
        days = F.extract(F.lit("DAY"), latest + F.expr("interval 1 day") - F.col("last")).cast("int")
    else:
        raise ValueError(f"recency is 'calendar' or 'elapsed', not {recency!r}")
    return stats.select(c.customer_id, days.alias("recency"), "frequency", "monetary")


def rfm_quantiles(rfm: DataFrame, *, approx: bool = False) -> DataFrame:
    """One row with r25..r75, f25..f75, m25..m75, linearly interpolated."""
    letters = {"r": "recency", "f": "frequency", "m": "monetary"}
    rows = quantiles_wide(rfm, list(letters.values()), QUARTILES, approx=approx)
    pick = "max(case when field = '{0}' then {1} end) as {2}{3:g}"
    return rows.agg(
        *[
            F.expr(pick.format(field, quantile_name(p), letter, p * 100))
            for letter, field in letters.items()
            for p in QUARTILES
        ]
    )


def rfm_scores(rfm: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """Scores 1..4: each quartile edge that a value passes costs recency a point and earns one
    for frequency and money; a value on an edge has not passed it. ``rfm_score`` is the sum.
    """
    edges = quantiles if quantiles is not None else rfm_quantiles(rfm)
    with_edges = rfm.withColumn("q", edges.agg(F.max(F.struct(*edges.columns)).alias("q")).scalar())
    passed = lambda letter, name: " + ".join(
        f"cast(cast({name} as double) > q.{letter}{p * 100:g} as int)" for p in QUARTILES
    )
    scored = with_edges.select(
        *rfm.columns,
        F.expr(f"4 - ({passed('r', 'recency')})").alias("r_score"),
        F.expr(f"1 + {passed('f', 'frequency')}").alias("f_score"),
        F.expr(f"1 + {passed('m', 'monetary')}").alias("m_score"),
    )
    return scored.withColumn("rfm_score", F.expr("r_score + f_score + m_score"))


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Scores with the name of the first segment rule that fits; money plays no part."""
    names = [
        F.when(F.col("r_score").between(*r) & F.col("f_score").between(*f), F.lit(name))
        for name, r, f in SEGMENT_RULES
    ]
    return scores.withColumn("segment", F.coalesce(*names))


def rfm_describe(
    scores: DataFrame,
    probabilities: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.99),
    columns: Sequence[str] = ("recency", "frequency", "monetary"),
    *,
    approx: bool = False,
) -> DataFrame:
    return describe_numeric(scores, list(columns), probabilities, approx=approx)


def rfm_segment_summary(segments: DataFrame) -> DataFrame:
    """Size, averages, revenue and shares of each segment, highest revenue first."""
    groups = segments.groupBy("segment").agg(
        F.count("*").alias("customers"),
        F.sum(F.col("recency").cast("bigint")).alias("days"),
        F.sum("frequency").alias("orders"),
        F.sum("monetary").alias("total"),
    )
    size = F.col("customers")
    return groups.select(
        "segment", "customers",
        percent(size, F.sum(size).over(Window.partitionBy())).alias("customer_share"),
        quotient(F.col("days"), size).alias("avg_recency"),
        quotient(F.col("orders"), size).alias("avg_frequency"),
        quotient(F.col("total"), size).alias("avg_monetary"),
        money(F.col("total")).alias("revenue"),
        percent(F.col("total"), F.sum("total").over(Window.partitionBy())).alias("revenue_share"),
    ).orderBy(F.desc("revenue"), "segment")


def segment_actions(summary: DataFrame) -> DataFrame:
    """Segments found in the data with their recommended action; some have none."""
    table = F.create_map(*[F.lit(text) for pair in SEGMENT_ACTIONS for text in pair])
    return summary.select("segment", "customers", table[F.col("segment")].alias("action"))
