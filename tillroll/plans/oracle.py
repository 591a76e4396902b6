"""SQL for DuckDB that states independently what each registered query must return."""

from __future__ import annotations

from tillroll.functions.columns import SERVICE_CODES
from tillroll.functions.expressions import WHITESPACE
from tillroll.operators.customers import SEGMENT_ACTIONS
from tillroll.plans.catalog import FIRST_COHORT, HOME, LAST_COHORT, VARIANT_CODE, YEARS

RAW_COLUMNS = "invoice, stock_code, description, quantity, invoice_date, price, customer_id, country, source_period"
SERVICE = ", ".join(f"'{code}'" for code in SERVICE_CODES)
BLANKS = " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)

# Texts of the raw lines are put together per row (an empty repeat after the country): DuckDB 2.0.0 can
# fail with an internal error on the dictionary of a text column that passes a join and a case unchanged.
RAW = """
star as (
  select l.*, o.o_custkey, o.o_orderdate, n.n_name, p.p_name, p.p_brand, p.p_retailprice
  from lineitem l join orders o on o.o_orderkey = l.l_orderkey
  join customer c on c.c_custkey = o.o_custkey
  join nation n on n.n_nationkey = c.c_nationkey
  join part p on p.p_partkey = l.l_partkey),
lines as (
  select
    concat(case when l_orderkey % 11 = 0 then 'C' when l_orderkey % 997 = 0 then 'c' else '' end,
           cast(l_orderkey + 400000 as string)) as invoice,
    case when l_partkey % 97 = 0 then 'POST' when l_partkey % 97 = 1 then 'M'
         when l_partkey % 97 = 2 then 'BANK CHARGES'
         when l_linenumber = 7 then concat(' ', cast(l_partkey as string), ' ')
         else cast(l_partkey as string) end as stock_code,
    case when l_partkey % 15 = 0 then null when l_suppkey % 10 = 0 then upper(p_name)
         when l_suppkey % 10 = 1 then concat(' ', p_name, ' ')
         else concat(p_name, ' ', p_brand) end as description,
    cast(case when l_orderkey % 11 = 0 or l_orderkey % 53 = 0 then -l_quantity else l_quantity end as int) as quantity,
    o_orderdate + interval '1' hour * (6 + l_orderkey % 15)
      + interval '1' minute * (case when l_orderkey % 50 = 0 then l_linenumber else 0 end) as invoice_date,
    cast(case when l_partkey % 601 = 3 then -1 when l_partkey % 61 = 4 then 0
         else cast(p_retailprice as decimal(18,4)) + cast(l_discount as decimal(18,4)) end as decimal(18,4)) as price,
    case when o_custkey % 5 = 0 then null when l_orderkey % 70 = 1 and l_linenumber = 1 then null
         else cast(o_custkey + 12000 as int) end as customer_id,
    concat(case when l_orderkey % 200 = 0 then 'EIRE' else n_name end, repeat('', l_linenumber)) as country,
    concat('P', cast(1 + cast(o_orderdate >= timestamp '1998-04-15 00:00:00' as int) as string)) as source_period,
    l_orderkey as k, l_linenumber as ln
  from star),
raw as (
  select invoice, stock_code, description, quantity, invoice_date, price, customer_id, country,
    concat('P', case when copy < 2 then right(source_period, 1) when source_period = 'P1' then '2' else '1' end)
      as source_period
  from lines cross join (values (0), (1), (2)) as t(copy)
  where copy = 0 or (copy = 1 and k % 89 = 0 and ln = 1) or (copy = 2 and k % 91 = 0 and ln = 2))"""

TRIMMED = f"""
trimmed as (
  select * replace (trim(stock_code, {BLANKS}) as stock_code, trim(description, {BLANKS}) as description,
                    trim(country, {BLANKS}) as country)
  from raw)"""

CLEAN = f"""{TRIMMED},
clean as (
  select distinct *, starts_with(invoice, 'C') as is_cancelled, quantity < 0 as is_negative_quantity,
    cast(quantity * price as decimal(18,4)) as line_total, stock_code in ({SERVICE}) as is_service
  from trimmed)"""

LINE_SALES = """
line_sales as (
  select * from clean where not (is_cancelled or is_service) and quantity > 0 and price > 0)"""

HEADERS = """
headers as (
  select invoice,
    (min({'t': invoice_date, 'v': customer_id}) filter (where customer_id is not null)).v as customer_id,
    min(invoice_date) as invoice_date,
    (min({'t': invoice_date, 'v': country})).v as country,
    bool_or(is_cancelled) as is_cancelled
  from clean group by invoice)"""

GOODS = """
goods as (
  select stock_code,
    (min({'n': -n, 'd': description}) filter (where description <> '')).d as description
  from (select stock_code, description, count(*) as n from clean group by all)
  group by stock_code)"""

ITEMS = """
items as (
  select row_number() over (
      order by invoice_date nulls last, invoice nulls last, stock_code nulls last, description nulls last,
        quantity nulls last, price nulls last, customer_id nulls last, country nulls last,
        source_period nulls last) as order_item_id,
    invoice, stock_code, quantity, price, line_total, is_service
  from clean)"""

SALES = f"""{HEADERS},{GOODS},{ITEMS},
sales as (
  select i.order_item_id, h.invoice, h.customer_id, h.invoice_date, h.country, i.stock_code, g.description,
    i.quantity, i.price, i.line_total
  from items i join headers h using (invoice) join goods g using (stock_code)
  where not (h.is_cancelled or i.is_service) and i.quantity > 0 and i.price > 0)"""


def r(x: str, digits: int = 2) -> str:
    """A double rounded half up from its ten-decimal form, as the queries round it."""
    return f"cast(round(cast({x} as decimal(38,10)), {digits}) as double)"


def m(x: str) -> str:
    return f"cast(round({x}, 2) as double)"


def d(x: str) -> str:
    return f"cast({x} as double)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return r(f"cast({part} as double) * 100 / nullif(cast({whole} as double), 0)", digits)


def avg(total: str, n: str) -> str:
    return r(f"cast({total} as double) / nullif(cast({n} as double), 0)")


def _with(*parts: str) -> str:
    return "with " + ",".join(parts)


def raw(sql: str, *more: str) -> str:
    return f"{_with(RAW, *more)}\n{sql}"


def clean(sql: str, *more: str) -> str:
    return f"{_with(RAW, CLEAN, *more)}\n{sql}"


def line_sales(sql: str, *more: str) -> str:
    return f"{_with(RAW, CLEAN, LINE_SALES, *more)}\n{sql}"


def sales(sql: str, *more: str) -> str:
    return f"{_with(RAW, CLEAN, SALES, *more)}\n{sql}"


# One row per column and value, from a single read of the table.
def _long(source: str, columns: dict[str, str]) -> str:
    names = ", ".join(f"'{name}'" for name in columns)
    values = ", ".join(columns.values())
    return f"(select unnest([{names}]) as field, unnest([{values}]) as v from {source})"


def described(source: str, columns: list[str], ps: list[float]) -> str:
    from tillroll.functions.ranking import quantile_name

    long = _long(source, {name: f"cast({name} as decimal(18,4))" for name in columns})
    quantiles = ", ".join(f"{r(f'quantile_cont(cast(v as double), {p})', 6)} as {quantile_name(p)}" for p in ps)
    return (
        f"select field, count(v) as count, {r('avg(v)', 6)} as mean, {r('stddev_samp(cast(v as double))')} as std,"
        f" {r('min(v)', 6)} as min, {quantiles}, {r('max(v)', 6)} as max from {long} group by field"
    )


def top(source: str, order: str, n: int, columns: str) -> str:
    return f"select {columns} from {source} order by {order} limit {n}"


RAW_ORDER = ", ".join(f"{name} nulls last" for name in RAW_COLUMNS.split(", "))
PREVIEW = "invoice, stock_code, description, quantity, cast(price as double) as price, customer_id"
RAW_OUT = RAW_COLUMNS.replace("price", "cast(price as double) as price")
CLEAN_OUT = "* replace (cast(price as double) as price, cast(line_total as double) as line_total)"

MONTHLY = f"""
monthly as (
  select cast(date_trunc('month', invoice_date) as date) as month, count(distinct invoice) as invoices,
    count(distinct customer_id) as customers, {m('sum(line_total)')} as revenue,
    {avg('sum(line_total)', 'count(distinct invoice)')} as average_invoice
  from sales group by 1)"""

FULL = """
inner_months as (
  select * from monthly
  where month <> (select min(month) from monthly) and month <> (select max(month) from monthly))"""

FREQUENCY = """
frequency as (
  select customer_id, count(distinct invoice) as orders_count
  from sales where customer_id is not null group by customer_id)"""

POSITION = "1 + cast(orders_count > 1 as int) + cast(orders_count > 5 as int) + cast(orders_count > 10 as int)"

GROUPED = f"placed as (select {POSITION} as p from frequency)"

# Months are numbered so that cohort arithmetic is a subtraction.
COHORTS = """
visits as (
  select distinct customer_id, year(invoice_date) * 12 + month(invoice_date) - 1 as m
  from sales where customer_id is not null),
activity as (
  select customer_id, m, min(m) over (partition by customer_id) as c from visits),
cohorts as (
  select c, m - c as month_number, count(*) as active_customers from activity group by all),
retained as (
  select make_date(cast(c // 12 as int), cast(c % 12 + 1 as int), 1) as cohort_month, month_number, active_customers,
    first_value(active_customers) over (partition by c order by month_number) as cohort_size
  from cohorts)"""

# The calendar of the test tables, from the first order's month to the last one's; tests hold it against the data.
MATRIX_MONTHS = 79

# The order of lines within one load.
APPENDED = """row_number() over (partition by source_period order by invoice_date nulls last, invoice nulls last,
  stock_code nulls last, description nulls last, quantity nulls last, price nulls last, customer_id nulls last,
  country nulls last)"""

RANGE = f"cohort_month between date '{FIRST_COHORT}' and date '{LAST_COHORT}'"


def rfm_from(source: str, recency: str, groups: str = "customer_id is not null") -> str:
    return f"""
latest as (select max(invoice_date) as t from {source} where {groups}),
rfm as (
  select customer_id, cast({recency} as int) as recency, frequency, monetary
  from (select customer_id, max(invoice_date) as last, count(distinct invoice) as frequency,
          sum(line_total) as monetary
        from {source} where {groups} group by customer_id), latest)"""


RFM = rfm_from("sales", "date_diff('day', cast(last as date), cast(t as date)) + 1")
RFM_ELAPSED = rfm_from(
    "line_sales", "floor(date_diff('second', last, t + interval '1' day) / 86400.0)"
)

EDGES = "edges as (select " + ", ".join(
    f"quantile_cont(cast({name} as double), {p / 100}) as {name[0]}{p}"
    for name in ("recency", "frequency", "monetary")
    for p in (25, 50, 75)
) + " from rfm)"

SCORES = f"""{EDGES},
scored as (
  select customer_id, recency, frequency, monetary,
    cast(4 - list_sum([cast(recency > e as int) for e in [r25, r50, r75]]) as int) as r_score,
    cast(1 + list_sum([cast(frequency > e as int) for e in [f25, f50, f75]]) as int) as f_score,
    cast(1 + list_sum([cast(cast(monetary as double) > e as int) for e in [m25, m50, m75]]) as int) as m_score
  from rfm, edges)"""

# The segments as a grid: rows are recency scores 4 to 1, columns frequency scores 1 to 4.
SEGMENTS = f"""{SCORES},
grid as (
  select * from (values
    (4, ['New customers', 'Potential loyalists', 'Loyal customers', 'Champions']),
    (3, ['Promising', 'Potential loyalists', 'Loyal customers', 'Loyal customers']),
    (2, ['Hibernating', 'Hibernating', 'At risk', 'At risk']),
    (1, ['Hibernating', 'Hibernating', 'At risk', 'At risk'])) as t(r, names)),
segmented as (
  select scored.*, r_score + f_score + m_score as rfm_score, names[f_score] as segment
  from scored join grid on r = r_score)"""

SUMMARY = f"""
summary as (
  select segment, count(*) as customers, {pct('count(*)', 'any_value(people)')} as customer_share,
    {avg('sum(recency)', 'count(*)')} as avg_recency, {avg('sum(frequency)', 'count(*)')} as avg_frequency,
    {avg('sum(monetary)', 'count(*)')} as avg_monetary, {m('sum(monetary)')} as revenue,
    {pct('sum(monetary)', 'any_value(money)')} as revenue_share
  from segmented, (select count(*) as people, sum(monetary) as money from rfm)
  group by segment)"""

SEGMENTED_OUT = "select * replace (cast(monetary as double) as monetary) from segmented"

COUNTRY = f"""country, {m('sum(line_total)')} as revenue, count(distinct invoice) as invoices,
  count(distinct customer_id) as customers, {avg('sum(line_total)', 'count(distinct invoice)')} as average_invoice"""

PRODUCT = f"""sum(quantity)::bigint as quantity, {m('sum(line_total)')} as revenue,
  count(distinct invoice) as invoices"""

DAY = "dayname(invoice_date) as weekday, cast(isodow(invoice_date) as int) as weekday_number"

WEEK = """(values ('Monday', 1), ('Tuesday', 2), ('Wednesday', 3), ('Thursday', 4), ('Friday', 5),
  ('Saturday', 6), ('Sunday', 7)) as week(weekday, weekday_number)"""


def one_of_each(table: str, conditions: dict[str, str], label: str, value: str) -> str:
    """Rows (label, count of the rows that meet the condition)."""
    names = ", ".join(f"'{name}'" for name in conditions)
    counts = ", ".join(f"count(*) filter (where {test})" for test in conditions.values())
    return f"select unnest([{names}]) as {label}, unnest([{counts}]) as {value} from {table}"


def _of_lines(sql: str) -> str:
    return sql.replace("from sales", "from line_sales")


def statements() -> dict[str, str]:
    y1, y2 = YEARS
    q: dict[str, str] = {}

    # sources and sinks
    raw_all = raw(f"select {RAW_COLUMNS} from raw")
    q["scan_labelled_union"] = raw_all
    q["scan_labelled_union_parquet"] = raw_all
    q["rename_columns"] = raw(
        'select invoice as "Invoice", customer_id as "Customer ID", stock_code, description, quantity, invoice_date,'
        " price, country, source_period from raw"
    )
    q["sink_stage"] = clean("select * from clean")
    q["scan_stage"] = raw("select invoice, quantity, customer_id from raw")
    orders_out = "select invoice, customer_id, invoice_date, country, is_cancelled from headers"
    q["scan_typed_csv"] = clean(orders_out, HEADERS)
    q["sink_csv_tables"] = clean(
        "select i.order_item_id, i.invoice, i.stock_code, i.quantity, i.price, i.line_total, h.customer_id,"
        " h.invoice_date, h.country, g.description, case when h.customer_id is not null then true end as known"
        " from items i join headers h using (invoice) join goods g using (stock_code)",
        HEADERS, GOODS, ITEMS,
    )
    q["sink_csv_summaries"] = sales(
        "select 'monthly_sales' as report, cast(month as string) as label, revenue from monthly"
        " union all select 'rfm_segments', segment, revenue from summary"
        f" union all select 'country_summary', country, {m('sum(line_total)')} from sales group by country"
        f" union all select 'product_summary', stock_code, {m('sum(line_total)')} from sales group by stock_code",
        MONTHLY, RFM, SEGMENTS, SUMMARY,
    )
    counts = (
        "select 'customers' as table_name, count(distinct customer_id) as rows_count from clean"
        " union all select 'products', count(distinct stock_code) from clean"
        " union all select 'orders', count(distinct invoice) from clean"
        " union all select 'order_items', count(*) from clean"
    )
    q["publish_tables"] = clean(
        f"select list_position(['customers', 'products', 'orders', 'order_items'], table_name) as load_order, *"
        f" from ({counts})"
    )
    q["register_views"] = sales(
        "select unnest(['v_sales', 'v_customer_sales', 'v_invoice_summary', 'v_monthly_metrics']) as view_name,"
        " unnest([count(*), count(customer_id), count(distinct invoice),"
        " count(distinct date_trunc('month', invoice_date))]) as rows from sales"
    )
    q["publish_catalog"] = sales(
        f"select table_name as name, rows_count as rows from ({counts}) union all select * from"
        " (select unnest(['v_sales', 'v_customer_sales', 'v_invoice_summary', 'v_monthly_metrics']) as name,"
        " unnest([count(*), count(customer_id), count(distinct invoice),"
        " count(distinct date_trunc('month', invoice_date))]) as rows from sales)"
    )
    q["publish_catalog_metrics"] = sales("select * from monthly", MONTHLY)
    q["register_tables"] = clean(
        "select is_cancelled, count(*) as rows, count(distinct invoice) as invoices, sum(line_total) as total"
        " from clean group by is_cancelled"
    )
    q["layout_tables"] = q["sink_stage"]
    q["layout_tables_pruned"] = clean(
        "select cast(date_trunc('month', invoice_date) as date) as order_month, count(*) as rows,"
        f" sum(line_total) as total from clean where year(invoice_date) = 1996 and country = '{HOME}' group by 1"
    )

    # cleaning
    q["cast_types"] = raw("select invoice, stock_code, customer_id, invoice_date from raw")
    q["cast_rejects"] = raw(
        "select unnest(['invoice', 'stock_code', 'price', 'customer_id']) as column_name,"
        " unnest([count(*) filter (where not regexp_full_match(invoice, '[0-9]+')),"
        " count(*) filter (where not regexp_full_match(trim(stock_code), '[0-9]+')),"
        " count(*) filter (where price <> floor(price)), 0]) as rejected_rows from raw"
    )
    q["trim_strings"] = f"{_with(RAW, TRIMMED)}\nselect * from trimmed"
    q["drop_exact_duplicates"] = raw("select distinct * from raw")
    q["drop_exact_duplicates_unlabelled"] = raw(
        "select * exclude (source_period), min(source_period) as source_period from raw group by all"
    )
    q["duplicates_removed"] = (
        f"{_with(RAW, TRIMMED)}\nselect sum(n)::bigint as rows_before,"
        " (sum(n) - count(*))::bigint as duplicates_removed, count(*) as rows_after"
        f" from (select count(*) as n from trimmed group by {RAW_COLUMNS})"
    )
    q["flag_cancelled"] = raw("select invoice, quantity, left(invoice, 1) = 'C' as is_cancelled from raw")
    q["flag_cancelled_any_case"] = raw(
        "select invoice, quantity, left(invoice, 1) in ('C', 'c') as is_cancelled from raw"
    )
    q["flag_negative_quantity"] = raw("select invoice, quantity, quantity < 0 as is_negative_quantity from raw")
    q["flag_service"] = raw(f"select invoice, stock_code, stock_code in ({SERVICE}) as is_service from raw")
    q["flag_service_by_table"] = raw(
        "select invoice, stock_code, max(price) over (partition by stock_code) <= 0 as is_service from raw"
    )
    q["derive_line_total"] = raw(
        f"select invoice, quantity, {d('price')} as price, {d('quantity * price')} as line_total from raw"
    )
    q["clean_lines"] = clean(f"select {CLEAN_OUT} from clean")
    q["filter_sales"] = line_sales(f"select {CLEAN_OUT} from line_sales")
    q["filter_customer_sales"] = line_sales(f"select {CLEAN_OUT} from line_sales where customer_id is not null")
    expectations = {
        "no_cancelled": "is_cancelled", "no_service": "is_service",
        "positive_quantity": "quantity <= 0", "positive_price": "price <= 0",
    }
    for key, base, table in (
        ("assert_expectations", line_sales, "line_sales"), ("assert_expectations_clean", clean, "clean")
    ):
        failed = one_of_each(table, expectations, "expectation", "failed_rows")
        q[key] = base(f"select *, failed_rows = 0 as passed from ({failed})")
    sold = "not (is_cancelled or is_service) and quantity > 0 and price > 0"
    kept = {
        "raw_rows": "any_value(n)", "clean_rows": "count(*)", "sales_rows": f"count(*) filter (where {sold})",
        "customer_sales_rows": f"count(customer_id) filter (where {sold})",
        "duplicates_removed": "any_value(n) - count(*)", "cancelled_rows": "count(*) filter (where is_cancelled)",
        "negative_quantity_rows": "count(*) filter (where quantity < 0)",
        "service_rows": "count(*) filter (where is_service)",
    }

    def report(metrics: dict[str, str]) -> str:
        names = ", ".join(f"'{name}'" for name in metrics)
        return clean(
            f"select unnest([{names}]) as metric, unnest([{', '.join(metrics.values())}]) as value from clean,"
            " (select count(*) as n, count(distinct (invoice, stock_code, description, quantity, invoice_date, price,"
            " customer_id, country)) as u from trimmed)"
        )

    q["cleaning_report"] = report(kept)
    q["cleaning_report_unlabelled"] = report(kept | {"duplicates_ignoring_source": "any_value(n) - any_value(u)"})
    q["preview_where"] = clean(top("clean where price <= 0", RAW_ORDER, 20, PREVIEW))
    q["preview_negative_quantity"] = raw(top("raw where quantity < 0", RAW_ORDER, 10, PREVIEW))
    q["preview_missing_description"] = raw(top("raw where description is null", RAW_ORDER, 10, PREVIEW))
    q["preview_cancelled"] = raw(top("raw where invoice like 'C%'", RAW_ORDER, 5, PREVIEW))
    q["preview_head"] = raw(top("raw", RAW_ORDER, 5, RAW_OUT))
    q["service_code_list"] = clean("select stock_code, description from clean where is_service group by all")

    # profiling
    q["profile_shape"] = raw("select count(*) as rows, 9 as columns from raw")
    types = {
        "invoice": "string", "stock_code": "string", "description": "string", "quantity": "int",
        "invoice_date": "timestamp_ntz", "price": "decimal(18,4)", "customer_id": "int", "country": "string",
        "source_period": "string",
    }
    listed = lambda values: ", ".join(f"'{value}'" for value in values)
    q["profile_schema"] = raw(
        f"select unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) as position, unnest([{listed(types)}]) as column_name,"
        f" unnest([{listed(types.values())}]) as data_type,"
        f" unnest([{', '.join(f'count({name})' for name in types)}]) as non_null from raw"
    )
    q["profile_main_info"] = raw(
        "select count(*) as rows, count(distinct invoice) as invoices, count(distinct stock_code) as products,"
        " count(distinct customer_id) as customers, count(distinct country) as countries from raw"
    )
    q["profile_time_range"] = raw("select min(invoice_date) as first_date, max(invoice_date) as last_date from raw")

    def frequencies(column: str, n: int | None) -> str:
        sql = f"select {column} as value, count(*) as rows from raw where {column} is not null group by 1"
        return raw(sql if n is None else f"{sql} order by rows desc, value limit {n}")

    q["value_counts"] = frequencies("source_period", None)
    q["value_counts_country"] = frequencies("country", 15)
    q["value_counts_description"] = frequencies("description", 20)
    q["value_counts_segment"] = sales(
        "select segment as value, count(*) as rows from segmented group by 1", RFM, SEGMENTS
    )
    missing = (
        f"select column_name, missing_count, {pct('missing_count', 'n', 4)} as missing_percent from ("
        f"select unnest([{listed(types)}]) as column_name,"
        f" unnest([{', '.join(f'count(*) - count({name})' for name in types)}]) as missing_count,"
        " count(*) as n from raw)"
    )
    q["missing_profile"] = raw(missing)
    q["missing_columns"] = raw(f"select * from ({missing}) where missing_count > 0")
    quartiles = [0.25, 0.5, 0.75]
    q["describe_numeric"] = raw(described("raw", ["quantity", "price"], quartiles))
    numbers = ["quantity", "price", "line_total"]
    q["describe_clean"] = clean(described("clean", numbers, quartiles))
    q["describe_sales"] = line_sales(described("line_sales", numbers, quartiles))
    long_sales = _long("line_sales", {name: f"cast({name} as double)" for name in numbers})
    q["quantile_table"] = line_sales(
        "select field, "
        + ", ".join(
            f"{r(f'quantile_cont(v, {p})', 6)} as {name}"
            for p, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (0.999, "p99_9"))
        )
        + f" from {long_sales} group by field"
    )
    q["duplicate_stats"] = raw(
        f"select cast(count(*) filter (where place > 1) as bigint) as duplicate_rows,"
        f" {pct('count(*) filter (where place > 1)', 'count(*)')} as duplicate_percent"
        f" from (select row_number() over (partition by {RAW_COLUMNS}) as place from raw)"
    )
    copied = f"(select * from raw qualify count(*) over (partition by {RAW_COLUMNS}) > 1)"
    q["duplicate_rows"] = raw(top(copied, RAW_ORDER, 10, RAW_OUT))
    q["duplicate_rows_all"] = raw(f"select {RAW_OUT} from {copied}")
    q["cancellation_stats"] = raw(
        "select count(*) filter (where c) as cancelled_rows, count(distinct invoice) filter (where c) as"
        f" cancelled_invoices, {pct('count(*) filter (where c)', 'count(*)')} as cancelled_percent"
        " from (select invoice, invoice like 'C%' as c from raw)"
    )
    q["suspicious_values"] = raw(
        "select count(*) filter (where quantity < 0) as quantity_below_zero,"
        " count(*) filter (where quantity = 0) as quantity_equal_zero,"
        " count(*) filter (where price < 0) as price_below_zero,"
        " count(*) filter (where price = 0) as price_equal_zero,"
        " count(*) filter (where customer_id is null) as missing_customer_id,"
        " count(*) filter (where description is null) as missing_description from raw"
    )
    q["price_checks"] = clean(
        one_of_each(
            "clean",
            {
                "negative_price": "price < 0", "zero_price": "price = 0",
                "missing_customer_id": "customer_id is null", "missing_description": "description is null",
            },
            "metric", "value",
        )
    )
    crossed = (
        "select quantity < 0 as negative, count(*) filter (where invoice not like 'C%') as \"false\","
        " count(*) filter (where invoice like 'C%') as \"true\" from {} group by 1"
    )
    q["crosstab_flags"] = raw(crossed.format("raw"))
    q["crosstab_flags_clean"] = clean(crossed.format("clean"))
    q["distinct_counts"] = raw(
        f"select unnest([{listed(types)}]) as column_name,"
        f" unnest([{', '.join(f'count(distinct {name})' for name in types)}]) as distinct_values from raw"
    )
    q["distinct_by_group"] = raw(
        "select country, count(distinct invoice) as invoices from raw group by 1 order by 2 desc, 1 limit 15"
    )
    q["top_n_rows"] = line_sales(
        top(
            "line_sales", f"line_total desc, {RAW_ORDER}", 15,
            "invoice, stock_code, description, quantity, cast(price as double) as price,"
            " cast(line_total as double) as line_total, customer_id, country",
        )
    )

    # keys and consistency
    q["fd_check"] = clean(
        "select unnest(['customers', 'dates', 'countries']) as dependant,"
        " unnest([max(a), max(b), max(c)]) as max_values,"
        " unnest([count(*) filter (where a > 1), count(*) filter (where b > 1), count(*) filter (where c > 1)])"
        " as violating_keys from (select count(distinct customer_id) as a, count(distinct invoice_date) as b,"
        " count(distinct country) as c from clean group by invoice)"
    )
    pairs = (
        "select invoice, invoice_date from (select distinct invoice, invoice_date from clean)"
        " qualify count(*) over (partition by invoice) > 1"
    )
    q["multi_date_rows"] = clean(f"select * from ({pairs}) order by invoice, invoice_date limit 30")
    q["multi_date_rows_all"] = clean(pairs)
    spread = (
        "select invoice, min(invoice_date) as min, max(invoice_date) as max,"
        f" {r('epoch(max(invoice_date) - min(invoice_date)) / 60.0', 6)} as diff_minutes"
        " from clean group by invoice having count(distinct invoice_date) > 1"
    )
    q["invoice_time_spread"] = clean(spread)
    q["invoice_time_spread_describe"] = clean(described(f"({spread})", ["diff_minutes"], quartiles))
    q["invoice_time_spread_top"] = clean(f"{spread} order by diff_minutes desc, invoice limit 10")
    q["customer_country_check"] = clean(
        "select count(*) filter (where n > 1) as customers_with_several, max(n) as max_countries from"
        " (select count(distinct country) as n from clean where customer_id is not null group by customer_id)"
    )
    variety = (
        "select stock_code, count(distinct description) as descriptions from clean"
        " group by 1 having count(description) > 0"
    )
    q["product_description_check"] = clean(
        "select count(*) filter (where descriptions > 1) as codes_with_several,"
        f" max(descriptions) as max_descriptions from ({variety})"
    )
    q["product_description_top"] = clean(f"{variety} order by descriptions desc, stock_code limit 10")
    q["description_variants"] = clean(
        f"select stock_code, description from clean where stock_code = '{VARIANT_CODE}' group by all"
    )

    # entities
    q["dim_customers"] = clean("select customer_id from clean group by 1 having customer_id is not null")
    q["dim_products"] = clean("select stock_code, description from goods", GOODS)
    q["dim_products_keep_empty"] = clean(
        "select stock_code, (min({'n': -n, 'd': d}) filter (where d is not null)).d as description from"
        " (select stock_code, case when regexp_matches(description, '^[A-Z]') then '' else description end as d,"
        " count(*) as n from clean group by all) group by stock_code"
    )
    q["fact_orders"] = q["scan_typed_csv"]
    items_out = (
        f"select order_item_id, invoice, stock_code, quantity, {d('price')} as price,"
        f" {d('line_total')} as line_total from items"
    )
    q["fact_order_items"] = clean(items_out, ITEMS)
    q["normalise"] = clean(
        "select 'customers' as table_name, count(*) as rows, sum(customer_id)::double as mark"
        " from (select distinct customer_id from clean where customer_id is not null)"
        " union all select 'products', count(*), count(description)::double from goods"
        " union all select 'orders', count(*), count(customer_id)::double from headers"
        " union all select 'order_items', count(*), sum(order_item_id)::double from items",
        HEADERS, GOODS, ITEMS,
    )

    # checks
    q["table_row_counts"] = clean(counts)
    q["check_unique"] = clean(
        f"select table_name, rows_count as rows, rows_count as distinct_keys, 0 as repeated_keys from ({counts})"
    )
    q["check_unique_violated"] = clean(
        "select 'clean_lines' as table_name, sum(n)::bigint as rows, count(*) as distinct_keys,"
        " count(*) filter (where n > 1) as repeated_keys from (select count(*) as n from clean group by invoice)"
    )
    def lost(child: str, key: str, parent: str, name: str) -> str:
        return (
            f"select count(*) as {name} from {child} c where not exists (select 1 from {parent} p where p.{key} = c.{key})"
        )

    no_order = lambda child: lost(child, "invoice", "headers", "items_without_order")
    no_product = lambda child, parent: lost(child, "stock_code", parent, "items_without_product")
    no_customer = lambda parent, child="headers": (
        lost(f"(select * from {child} where customer_id is not null)", "customer_id", parent,
             "orders_without_known_customer")
    )
    missing_101 = lambda x: (
        f"(select * replace (case when order_item_id % 101 <> 0 then {x} end as {x}) from items)"
    )
    lost_7 = lambda x: f"(select * replace (case when invoice not like '%7' then {x} end as {x}) from headers)"
    every_customer = "(select distinct customer_id from clean where customer_id is not null)"
    q["check_fk_items_orders"] = clean(no_order("items"), HEADERS, ITEMS)
    q["check_fk_items_orders_violated"] = clean("select count(*) as items_without_order from clean where is_cancelled")
    q["check_fk_items_orders_missing"] = clean(no_order(missing_101("invoice")), HEADERS, ITEMS)
    q["check_fk_items_products"] = clean(no_product("items", "goods"), GOODS, ITEMS)
    q["check_fk_items_products_violated"] = clean(
        no_product("items", "(select * from goods where description is not null)"), GOODS, ITEMS
    )
    q["check_fk_items_products_missing"] = clean(no_product(missing_101("stock_code"), "goods"), GOODS, ITEMS)
    q["check_fk_orders_customers"] = clean(no_customer(every_customer), HEADERS)
    q["check_fk_orders_customers_violated"] = sales(
        no_customer("(select * from frequency where orders_count > 5)"), FREQUENCY
    )
    q["check_fk_orders_customers_missing"] = clean(no_customer(every_customer, lost_7("customer_id")), HEADERS)
    required = {
        "customers": ["customer_id"], "products": ["stock_code"],
        "orders": ["invoice", "invoice_date", "country", "is_cancelled"],
        "order_items": ["order_item_id", "invoice", "stock_code", "quantity", "price", "line_total"],
    }
    bounded = {
        "customers": {"customer_id": "customer_id > 2147483647"},
        "products": {"stock_code": "len(stock_code) > 30"},
        "orders": {
            "invoice": "len(invoice) > 30", "customer_id": "customer_id > 2147483647", "country": "len(country) > 100",
        },
        "order_items": {
            "invoice": "len(invoice) > 30", "stock_code": "len(stock_code) > 30",
            "quantity": "quantity > 2147483647", "price": "abs(price) >= 1e14", "line_total": "abs(line_total) >= 1e14",
        },
    }
    tables = {
        "customers": "(select distinct customer_id from clean where customer_id is not null)",
        "products": "goods", "orders": "headers", "order_items": "items",
    }

    def violations(tests: dict[str, dict[str, str]], **changed: str) -> str:
        parts = []
        for name, conditions in tests.items():
            found = one_of_each({**tables, **changed}[name], conditions, "column_name", "violations")
            parts.append(f"select '{name}' as table_name, * from ({found})")
        return clean(" union all ".join(parts), HEADERS, GOODS, ITEMS)

    q["check_not_null"] = violations({t: {x: f"{x} is null" for x in cols} for t, cols in required.items()})
    q["check_domain"] = violations(bounded)
    nulls = {t: {x: f"{x} is null" for x in cols} for t, cols in required.items()}
    q["check_not_null_violated"] = violations(nulls, orders=lost_7("country"), order_items=missing_101("quantity"))
    q["check_domain_violated"] = violations(
        bounded,
        products="(select * replace (case when stock_code like '%7' then repeat(stock_code, 31) else stock_code end"
        " as stock_code) from goods)",
        orders="(select * replace (case when country = 'EIRE' then repeat(country, 30) else country end as country)"
        " from headers)",
        order_items="(select * replace (cast(price as double) * case when order_item_id % 101 = 0 then 1e14 else 1 end"
        " as price) from items)",
    )
    q["check_line_total_violated"] = clean(
        "select count(*) as line_total_mismatch from items where order_item_id % 101 = 0", ITEMS
    )
    q["check_cancelled_flag"] = clean(
        "select count(distinct invoice) as cancelled_flag_mismatch from clean where invoice like 'c%'"
    )
    q["check_line_total"] = clean(
        "select count(*) as line_total_mismatch from clean where abs(line_total - quantity * price) > 0.01"
    )
    q["check_missing_description"] = clean(
        "select count(*) filter (where description is null) as products_without_description from goods", GOODS
    )
    q["check_value_signs"] = clean(
        "select count(*) filter (where quantity < 0) as negative_quantity_rows,"
        " count(*) filter (where price = 0) as zero_price_rows,"
        " count(*) filter (where price < 0) as negative_price_rows from clean"
    )
    rows_out = "select count(*) as sales_rows, count(customer_id) as customer_sales_rows from"
    q["sales_row_counts"] = sales(f"{rows_out} sales")
    q["sales_row_counts_by_line"] = line_sales(f"{rows_out} line_sales")
    overview = (
        "select min(invoice_date) as first_date, max(invoice_date) as last_date, count(distinct invoice) as invoices,"
        " count(distinct customer_id) as customers, count(distinct stock_code) as products,"
        f" {m('sum(line_total)')} as revenue from"
    )
    q["sales_overview"] = sales(f"{overview} sales")
    q["sales_overview_by_line"] = line_sales(f"{overview} line_sales")

    # views
    q["v_sales"] = sales(f"select {CLEAN_OUT} from sales")
    q["v_customer_sales"] = sales(f"select {CLEAN_OUT} from sales where customer_id is not null")
    q["v_invoice_summary"] = sales(
        "select invoice, any_value(customer_id) as customer_id, any_value(invoice_date) as invoice_date,"
        " any_value(country) as country, sum(quantity)::bigint as items_count,"
        f" {m('sum(line_total)')} as revenue from sales group by invoice"
    )
    q["v_monthly_metrics"] = sales("select * from monthly", MONTHLY)

    # sales over time
    q["core_metrics"] = sales(
        "select count(*) as sales_rows, count(distinct invoice) as invoices, count(distinct customer_id) as customers,"
        f" count(distinct stock_code) as products, {m('sum(line_total)')} as revenue,"
        f" {avg('sum(line_total)', 'count(distinct invoice)')} as average_invoice from sales"
    )
    q["monthly_metrics"] = q["v_monthly_metrics"]
    q["monthly_metrics_by_line"] = line_sales("select * from monthly", _of_lines(MONTHLY))
    q["full_months"] = sales("select * from inner_months", MONTHLY, FULL)
    q["best_worst_month"] = sales(
        "(select 'best' as kind, * from inner_months order by revenue desc, month limit 1) union all"
        " (select 'worst' as kind, * from inner_months order by revenue, month limit 1)",
        MONTHLY, FULL,
    )
    growth = (
        "select month, revenue, previous_revenue,"
        f" {pct('revenue - previous_revenue', 'previous_revenue')} as revenue_growth_pct from"
    )
    shifted = "(select month, revenue, lag(revenue) over (order by month) as previous_revenue from {})"
    q["mom_growth"] = sales(f"{growth} {shifted.format('monthly')}", MONTHLY)
    calendar = (
        "(select cast(t as date) as month, revenue from (select unnest(generate_series(min(month)::timestamp,"
        " max(month)::timestamp, interval '1' month)) as t from monthly) left join monthly on month = cast(t as date))"
    )
    q["mom_growth_filled"] = sales(f"{growth} {shifted.format(calendar)}", MONTHLY)
    q["yoy_compare"] = sales(
        f"select n as month_number, a as revenue_{y1}, b as revenue_{y2}, {pct('b - a', 'a')} as growth_pct from"
        f" (select cast(month(month) as int) as n, max(case year(month) when {y1} then revenue end) as a,"
        f" max(case year(month) when {y2} then revenue end) as b from monthly"
        f" where year(month) in ({y1}, {y2}) and month(month) < 12 group by 1)",
        MONTHLY,
    )

    # customers
    q["orders_per_customer"] = sales("select * from frequency", FREQUENCY)
    q["orders_per_customer_by_line"] = line_sales("select * from frequency", _of_lines(FREQUENCY))
    q["repeat_rate"] = sales(
        "select count(*) as customers, count(*) filter (where orders_count = 1) as one_time_customers,"
        " count(*) filter (where orders_count > 1) as repeat_customers,"
        f" {pct('count(*) filter (where orders_count > 1)', 'count(*)')} as repeat_customer_rate from frequency",
        FREQUENCY,
    )
    q["orders_distribution"] = sales(
        described("frequency", ["orders_count"], [0.5, 0.75, 0.9, 0.95, 0.99]), FREQUENCY
    )
    q["orders_histogram"] = sales(
        f"select b as bin, {r('lo + (hi - lo) * (b - 1) / 30.0', 6)} as bin_from,"
        f" {r('lo + (hi - lo) * b / 30.0', 6)} as bin_to, count(orders_count) as customers"
        " from (select unnest(range(1, 31)) as b, min(orders_count) as lo, max(orders_count) as hi from kept)"
        " left join kept on b = least((orders_count - lo) * 30 // (hi - lo), 29) + 1 group by b, lo, hi",
        FREQUENCY,
        "kept as (select orders_count from frequency where orders_count <="
        " (select quantile_cont(cast(orders_count as double), 0.99) from frequency))",
    )
    labels = "['1', '2-5', '6-10', '>10']"
    q["order_groups"] = sales(
        f"select {labels}[g] as orders_group, customers, {pct('customers', 'sum(customers) over ()')} as customer_share"
        f" from (select {POSITION} as g, count(*) as customers from frequency group by 1)",
        FREQUENCY,
    )
    q["order_groups_filled"] = sales(
        f"select {labels}[g] as orders_group, count(p) as customers,"
        f" {pct('count(p)', '(select count(*) from placed)')} as customer_share"
        " from (select unnest([1, 2, 3, 4]) as g) left join placed on p = g group by g",
        FREQUENCY,
        GROUPED,
    )
    as_date = lambda x: f"make_date(cast({x} // 12 as int), cast({x} % 12 + 1 as int), 1)"
    q["cohort_activity"] = sales(
        f"select customer_id, {as_date('c')} as cohort_month, {as_date('m')} as order_month,"
        " cast(m - c as int) as month_number from activity",
        COHORTS,
    )
    q["cohort_retention"] = sales(
        "select cohort_month, cast(month_number as int) as month_number, cohort_size, active_customers,"
        f" {pct('active_customers', 'cohort_size')} as retention_rate from retained"
        f" where {RANGE} and month_number in (1, 2, 3, 4, 5, 6)",
        COHORTS,
    )

    def matrix(months, where: str) -> str:
        rate = pct("active_customers", "cohort_size")
        cells = ", ".join(f"max({rate}) filter (where month_number = {k}) as month_{k}" for k in months)
        return sales(
            f"select cohort_month, {cells} from retained where {where} and month_number <= {max(months)}"
            " group by 1",
            COHORTS,
        )

    q["retention_matrix"] = matrix(range(MATRIX_MONTHS), "true")
    q["retention_heatmap"] = matrix(range(1, 7), RANGE)
    q["retention_summary"] = matrix((1, 3, 6), RANGE)
    rate = "active_customers * 100.0::double / cohort_size"
    q["retention_summary_mean"] = sales(
        "select "
        + ", ".join(f"{r(f'avg({rate}) filter (where month_number = {k})')} as month_{k}" for k in (1, 3, 6))
        + f" from retained where {RANGE}",
        COHORTS,
    )
    rfm_out = f"select customer_id, recency, frequency, {d('monetary')} as monetary from rfm"
    q["rfm_customer"] = sales(rfm_out, RFM)
    q["rfm_customer_elapsed"] = line_sales(rfm_out, RFM_ELAPSED)
    q["rfm_quantiles"] = sales(
        "select " + ", ".join(f"{r(x + p, 6)} as {x}{p}" for x in "rfm" for p in ("25", "50", "75")) + " from edges",
        RFM, EDGES,
    )
    q["rfm_scores"] = sales(
        f"select * exclude (segment) from ({SEGMENTED_OUT})", RFM, SEGMENTS
    )
    q["rfm_segments"] = sales(SEGMENTED_OUT, RFM, SEGMENTS)
    q["rfm_segments_elapsed"] = line_sales(SEGMENTED_OUT, RFM_ELAPSED, SEGMENTS)
    q["rfm_describe"] = sales(
        described("rfm", ["recency", "frequency", "monetary"], [0.25, 0.5, 0.75, 0.9, 0.99]), RFM
    )
    q["rfm_describe_scores"] = sales(
        described("segmented", ["r_score", "f_score", "m_score", "rfm_score"], quartiles), RFM, SEGMENTS
    )
    q["rfm_segment_summary"] = sales("select * from summary", RFM, SEGMENTS, SUMMARY)
    actions = ", ".join(f"('{segment}', '{action}')" for segment, action in SEGMENT_ACTIONS)
    q["segment_actions"] = sales(
        f"select segment, customers, action from summary left join (values {actions}) as a(segment, action)"
        " using (segment)",
        RFM, SEGMENTS, SUMMARY,
    )

    # countries, products, activity
    q["country_summary"] = sales(f"select {COUNTRY} from sales group by country")
    q["country_summary_by_line"] = line_sales(
        f"select {COUNTRY} from line_sales group by country order by revenue desc, country limit 15"
    )
    q["home_country_share"] = sales(
        f"select '{HOME}' as country, {pct('sum(total) filter (where home)', 'sum(total)')} as revenue_share from"
        f" (select country = '{HOME}' as home, sum(line_total) as total from sales group by 1)"
    )
    q["top_countries_excluding"] = sales(
        f"select country, {m('sum(line_total)')} as revenue from sales where country <> '{HOME}'"
        " group by country order by revenue desc, country limit 10"
    )
    product = f"select stock_code, any_value(description) as description, {PRODUCT} from sales group by stock_code"
    q["product_summary"] = sales(f"{product} order by revenue desc, stock_code limit 20")
    q["product_summary_all"] = sales(product)
    q["product_summary_by_quantity"] = line_sales(
        f"select * from (select stock_code, {PRODUCT} from line_sales group by stock_code"
        " order by quantity desc, stock_code limit 15) left join goods using (stock_code)",
        GOODS,
    )
    q["product_summary_line_descriptions"] = line_sales(
        "select stock_code, (min({'t': invoice_date, 'd': description}) filter (where description is not null)).d"
        f" as description, {PRODUCT} from line_sales group by stock_code order by revenue desc, stock_code limit 15"
    )
    q["top_products_ascending"] = sales(
        f"select stock_code, description, revenue from ({product}) order by revenue desc, stock_code limit 10"
    )
    q["product_concentration"] = sales(
        f"select {pct('list_sum(t[1:10])', 'list_sum(t)')} as top_10_share,"
        f" {pct('list_sum(t[1:100])', 'list_sum(t)')} as top_100_share from"
        " (select list(total order by total desc) as t from"
        " (select sum(line_total) as total from sales group by stock_code))"
    )
    q["weekday_activity"] = sales(f"select {DAY}, count(distinct invoice) as invoices from sales group by 1, 2")
    moments = f"(select {DAY}, hour(invoice_date) as hour from (select distinct invoice, invoice_date from line_sales))"
    by_day = f"(select weekday, count(*) as invoices from {moments} group by 1)"
    q["weekday_activity_by_time"] = line_sales(f"select * from {WEEK} left join {by_day} using (weekday)")
    dated = f"(select {DAY}, invoice from sales)"
    q["weekday_activity_filled"] = sales(
        f"select weekday, weekday_number, invoices from {WEEK} left join"
        f" (select weekday, count(distinct invoice) as invoices from {dated} group by 1) using (weekday)"
    )
    q["busiest_weekday"] = line_sales(
        f"select weekday, invoices from {WEEK} join {by_day} using (weekday)"
        " order by invoices desc, weekday_number limit 1"
    )
    q["hour_activity"] = sales(
        "select cast(hour(invoice_date) as int) as hour, count(distinct invoice) as invoices from sales group by 1"
    )
    by_hour = f"select cast(hour as int) as hour, count(*) as invoices from {moments} group by 1"
    q["hour_activity_by_time"] = line_sales(by_hour)
    q["busiest_hour"] = line_sales(f"{by_hour} order by invoices desc, hour limit 1")
    q["known_unknown_revenue"] = sales(
        "select if(known, 'known customer', 'unknown customer') as customer_group, invoices,"
        f" {m('total')} as revenue, {pct('total', 'sum(total) over ()')} as revenue_share from"
        " (select customer_id is not null as known, count(distinct invoice) as invoices, sum(line_total) as total"
        " from sales group by 1)"
    )

    # layouts, versions, appended loads, rejects, stored sketches
    q["bucket_tables"] = q["v_sales"]
    q["bucket_tables_lookup"] = clean(
        "select country, is_cancelled, count(*) as orders from headers"
        f" where invoice in (select invoice from clean where stock_code = '{VARIANT_CODE}') group by all",
        HEADERS,
    )
    q["publish_version"] = clean(
        "select unnest(['customers', 'products', 'orders', 'order_items']) as table_name,"
        " unnest([count(distinct customer_id), count(distinct stock_code), count(distinct invoice), count(*)])"
        " as rows_count from clean"
    )
    q["publish_version_former"] = clean(
        "select * from headers", HEADERS.replace("from clean", "from clean where source_period = 'P1'")
    )
    q["publish_views"] = q["monthly_metrics"]
    q["append_lines"] = clean(
        "select row_number() over (order by source_period, k) as order_item_id, invoice, stock_code, quantity,"
        " cast(price as double) as price, cast(line_total as double) as line_total"
        f" from (select *, {APPENDED} as k from clean)"
    )
    q["append_lines_parents"] = sales(
        f"select country, description, count(*) as lines, {d('sum(line_total)')} as total from sales group by all"
    )
    q["append_lines_unlabelled"] = clean(
        "select count(*) as items, count(*) as last_key from (select distinct invoice, stock_code, description,"
        " quantity, invoice_date, price, customer_id, country from clean)"
    )
    number = "cast(regexp_extract(invoice, '[0-9]+') as bigint)"
    q["scan_union_with_rejects"] = raw(f"select {RAW_OUT} from raw where {number} % 101 <> 0 and {number} % 103 <> 0")
    q["reject_report"] = raw(
        "select source_period, count(*) filter (a <> 0 and b <> 0) as lines_read,"
        " count(*) filter (a = 0 or b = 0) as lines_rejected, count(*) filter (a = 0) as bad_quantities,"
        " count(*) filter (b = 0) as bad_prices"
        f" from (select source_period, {number} % 101 as a, {number} % 103 as b from raw) group by 1"
    )
    q["month_sketches"] = sales(
        "select cast(date_trunc('quarter', invoice_date) as date) as period, count(distinct customer_id) as customers,"
        f" count(distinct invoice) as invoices, {m('sum(line_total)')} as revenue from sales group by 1"
    )
    q["range_metrics"] = sales(
        "select cast(date_trunc('month', min(invoice_date)) as date) as first_month,"
        " cast(date_trunc('month', max(invoice_date)) as date) as last_month,"
        " count(distinct customer_id) as customers, count(distinct invoice) as invoices,"
        f" {m('sum(line_total)')} as revenue, {avg('sum(line_total)', 'count(distinct invoice)')} as average_invoice"
        " from sales where invoice_date >= date '1996-03-01' and invoice_date < date '1998-12-01'"
    )
    bought = lambda y: f"(select distinct customer_id from sales where year(invoice_date) = {y} and customer_id > 0)"
    q["returning_customers"] = sales(
        f"select (select count(*) from {bought(y1)}) as earlier_customers,"
        f" (select count(*) from {bought(y2)}) as later_customers,"
        f" (select count(*) from {bought(y1)} join {bought(y2)} using (customer_id)) as returning_customers"
    )
    q["watch_expectations"] = q["assert_expectations_clean"]
    q["month_sets"] = sales(
        "select customer_id, cast(count(*) as int) as active_months from visits group by 1", COHORTS
    )
    q["cohort_activity_merged"] = q["cohort_activity"]

    # the same reports over lines with their own time, customer and country
    of_lines = {
        "core_metrics": (), "full_months": (MONTHLY, FULL), "best_worst_month": (MONTHLY, FULL),
        "yoy_compare": (MONTHLY,), "repeat_rate": (FREQUENCY,), "orders_distribution": (FREQUENCY,),
        "cohort_retention": (COHORTS,), "home_country_share": (), "top_countries_excluding": (),
        "product_concentration": (),
    }
    for name, parts in of_lines.items():
        report = q[name].removeprefix(_with(RAW, CLEAN, SALES, *parts) + "\n")
        q[f"{name}_by_line"] = line_sales(_of_lines(report), *map(_of_lines, parts))
    q["order_groups_by_line"] = line_sales(
        _of_lines(q["order_groups_filled"].removeprefix(_with(RAW, CLEAN, SALES, FREQUENCY, GROUPED) + "\n")),
        _of_lines(FREQUENCY), GROUPED,
    )
    q["rfm_segment_summary_elapsed"] = line_sales("select * from summary", RFM_ELAPSED, SEGMENTS, SUMMARY)
    q["product_summary_by_line"] = line_sales(
        f"select * from (select stock_code, {PRODUCT} from line_sales group by stock_code"
        " order by revenue desc, stock_code limit 15) left join goods using (stock_code)",
        GOODS,
    )
    return q
