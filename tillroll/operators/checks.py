"""Constraints and reconciliation of the entities; each check returns its violations."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import ENTITY_SCHEMAS, LOAD_ORDER, MONEY, PRIMARY_KEYS, TEXT_LENGTHS
from tillroll.operators.cleaning import cancelled


class ConstraintError(ValueError):
    """Entities break a declared constraint."""


def table_row_counts(entities: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rows_count) of the given tables."""
    counts = [
        frame.agg(F.count("*").alias("rows_count")).select(F.lit(name).alias("table_name"), "rows_count")
        for name, frame in entities.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def check_unique(df: DataFrame, key: str, name: str) -> DataFrame:
    """(table_name, rows, distinct_keys, repeated_keys) of a primary key."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(key).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
    ).select(F.lit(name).alias("table_name"), "rows", "distinct_keys", "repeated_keys")


def check_all_unique(entities: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [check_unique(entities[name], PRIMARY_KEYS[name], name) for name in LOAD_ORDER],
    )


def orphans(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str, *, optional: bool = False
) -> DataFrame:
    """One row ``name``: child rows without a parent.

    A missing key has no parent and counts, unless the reference is ``optional``. Child rows are
    counted per key before the join, so a key with most rows is one row there.
    """
    referring = child.filter(F.col(child_key).isNotNull()) if optional else child
    keys = referring.groupBy(F.col(child_key).alias("_key"))
    parents = parent.select(F.col(parent_key).alias("_key"))
    lost = keys.agg(F.count("*").alias("_n")).join(parents, "_key", "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(name))


def check_fk_items_orders(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    return orphans(order_items, "invoice", orders, "invoice", "items_without_order")


def check_fk_items_products(order_items: DataFrame, products: DataFrame) -> DataFrame:
    return orphans(order_items, "stock_code", products, "stock_code", "items_without_product")


def check_fk_orders_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orphans(orders, "customer_id", customers, "customer_id", "orders_without_known_customer", optional=True)


def _violations(df: DataFrame, table: str, tests: Mapping[str, Column]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(x) for x, test in tests.items()])
    rows = counts.unpivot([], list(tests), "column_name", "violations")
    return rows.select(F.lit(table).alias("table_name"), "column_name", "violations")


def _null_tests(table: str) -> dict[str, Column]:
    return {f.name: F.col(f.name).isNull() for f in ENTITY_SCHEMAS[table] if not f.nullable}


def check_not_null(entities: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, violations): missing values in required columns."""
    found = [_violations(entities[name], name, _null_tests(name)) for name in LOAD_ORDER]
    return reduce(DataFrame.unionByName, found)


def _outside(name: str, target: T.DataType, length: int | None) -> Column | None:
    if length is not None:
        return F.length(name) > length
    if isinstance(target, T.IntegerType) or target == MONEY:
        return F.col(name).isNotNull() & F.col(name).try_cast(target).isNull()
    return None


def _domain_tests(table: str) -> dict[str, Column]:
    lengths = TEXT_LENGTHS.get(table, {})
    tests = {f.name: _outside(f.name, f.dataType, lengths.get(f.name)) for f in ENTITY_SCHEMAS[table]}
    return {x: test for x, test in tests.items() if test is not None}


def check_domain(entities: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, violations): texts too long, numbers outside their type."""
    found = [_violations(entities[name], name, _domain_tests(name)) for name in LOAD_ORDER]
    return reduce(DataFrame.unionByName, found)


def check_cancelled_flag(orders: DataFrame) -> DataFrame:
    """Orders whose flag differs from the prefix rule read without regard to case."""
    expected = cancelled("invoice", case_insensitive=True)
    return orders.agg(F.count_if(F.col("is_cancelled") != expected).alias("cancelled_flag_mismatch"))


def check_line_total(order_items: DataFrame, tolerance: str = "0.01") -> DataFrame:
    gap = F.abs(F.col("line_total") - F.col("quantity") * F.col("price"))
    return order_items.agg(F.count_if(gap > F.lit(tolerance).cast(MONEY)).alias("line_total_mismatch"))


def check_missing_description(products: DataFrame) -> DataFrame:
    return products.agg(F.count_if(F.col("description").isNull()).alias("products_without_description"))


def check_value_signs(order_items: DataFrame) -> DataFrame:
    return order_items.agg(
        F.count_if(F.col("quantity") < 0).alias("negative_quantity_rows"),
        F.count_if(F.col("price") == 0).alias("zero_price_rows"),
        F.count_if(F.col("price") < 0).alias("negative_price_rows"),
    )


def sales_row_counts(sales: DataFrame) -> DataFrame:
    """(sales_rows, customer_sales_rows)."""
    return sales.agg(F.count("*").alias("sales_rows"), F.count("customer_id").alias("customer_sales_rows"))


def row_rules(table: str) -> dict[str, Column]:
    """The rules on single rows of a table by name; each holds where it is broken."""
    rules = {f"not null {table}.{x}": test for x, test in _null_tests(table).items()}
    return rules | {f"domain {table}.{x}": test for x, test in _domain_tests(table).items()}


def key_violations(entities: Mapping[str, DataFrame]) -> DataFrame:
    """(constraint, violations) over keys and references."""
    unique = check_all_unique(entities).select(
        F.concat(F.lit("unique "), "table_name").alias("constraint"), F.col("repeated_keys").alias("violations")
    )
    references = [
        check_fk_items_orders(entities["order_items"], entities["orders"]),
        check_fk_items_products(entities["order_items"], entities["products"]),
        check_fk_orders_customers(entities["orders"], entities["customers"]),
    ]
    parts = [unique]
    for frame in references:
        name = frame.columns[0]
        parts.append(frame.select(F.lit(name).alias("constraint"), F.col(name).alias("violations")))
    return reduce(DataFrame.unionByName, parts)


def constraint_violations(entities: Mapping[str, DataFrame]) -> DataFrame:
    """(constraint, violations) over keys, references, required columns and domains."""
    parts = [key_violations(entities)]
    for table in LOAD_ORDER:  # all rules on the rows of a table in one pass
        rules = row_rules(table)
        parts.append(
            _violations(entities[table], table, {x.replace(".", "|"): test for x, test in rules.items()}).select(
                F.replace("column_name", F.lit("|"), F.lit(".")).alias("constraint"), "violations"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def watched(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``df`` whose broken ``rules`` are counted while something else is done with it, and how to read the counts.

    The counts (and the number of rows, under ``rows``) belong to the first action on the frame and are known when that has
    ended; reading them costs no scan. A rule that is unknown on a row is not broken there.
    """
    seen = Observation()
    names = {f"r{i}": name for i, name in enumerate(rules)}
    counts = [F.count_if(F.coalesce(rules[name], F.lit(False))).alias(short) for short, name in names.items()]
    frame = df.observe(seen, F.count("*").alias("rows"), *counts)
    return frame, lambda: {names.get(short, short): n for short, n in seen.get.items()}


def raise_broken(violations: Mapping[str, int]) -> None:
    """Raise ``ConstraintError`` naming every constraint that is broken."""
    broken = {name: n for name, n in violations.items() if n}
    if broken:
        raise ConstraintError(", ".join(f"{name}: {n}" for name, n in broken.items()))


def require_valid(entities: Mapping[str, DataFrame]) -> None:
    """Raise ``ConstraintError`` naming every constraint that is broken."""
    broken = constraint_violations(entities).filter(F.col("violations") > 0).collect()
    raise_broken({row["constraint"]: row["violations"] for row in broken})
