"""Order lines made from the star-schema test tables, with known data problems mixed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import MONEY

TABLES = ("lineitem", "orders", "customer", "nation", "part")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _copies(k: Column, ln: Column) -> Column:
    """0 for every line, 1 for those doubled, 2 for those repeated under the other label."""
    marks = F.array(
        F.lit(0),
        F.when((k % 89 == 0) & (ln == 1), F.lit(1)),
        F.when((k % 91 == 0) & (ln == 2), F.lit(2)),
    )
    return F.explode(F.array_compact(marks))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order lines with cancellations, service codes, blanks, gaps and copies.

    Four equi-joins from the lines to their parents. Lines and orders grow together, so that
    join is always a sort-merge join (whose hot keys the adaptive skew join splits); the other
    parents are broadcast only when their measured size allows it. The copies are an explode of
    at most three, not a join.
    """
    lineitem, orders, customer, nation, part = (read_table(spark, sf_dir, name) for name in TABLES)
    placed = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
    goods = part.select("p_partkey", "p_name", "p_brand", "p_retailprice")
    sold = lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        (F.col("l_suppkey") % 10).alias("l_suppkind"), F.col("l_discount").cast(MONEY).alias("l_discount"),
    )
    # The names of nations come last, so that their numbers are shuffled instead.
    base = (
        sold.join(placed.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(goods, F.col("p_partkey") == F.col("l_partkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    )
    k, ln, pk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    sk, name = F.col("l_suppkind"), F.col("p_name")
    ordered = F.col("o_orderdate").cast("timestamp_ntz")
    prefix = F.when(k % 11 == 0, "C").when(k % 997 == 0, "c").otherwise("")
    code = pk.cast("string")
    stock_code = (
        F.when(pk % 97 == 0, "POST")
        .when(pk % 97 == 1, "M")
        .when(pk % 97 == 2, "BANK CHARGES")
        .when(ln == 7, F.concat(F.lit(" "), code, F.lit(" ")))
        .otherwise(code)
    )
    description = (
        F.when(pk % 15 == 0, F.lit(None))
        .when(sk == 0, F.upper(name))
        .when(sk == 1, F.concat(F.lit(" "), name, F.lit(" ")))
        .otherwise(F.concat(name, F.lit(" "), F.col("p_brand")))
    )
    quantity = F.col("l_quantity")
    minutes = F.when(k % 50 == 0, ln).otherwise(0)
    listed = F.col("p_retailprice").cast(MONEY) + F.col("l_discount")
    customer_id = F.when(
        (F.col("o_custkey") % 5 != 0) & ~((k % 70 == 1) & (ln == 1)), F.col("o_custkey") + 12000
    )
    period = F.when(ordered < F.lit("1998-04-15").cast("timestamp_ntz"), "P1").otherwise("P2")
    lines = base.select(
        F.concat(prefix, (k + 400000).cast("string")).alias("invoice"),
        stock_code.alias("stock_code"),
        description.alias("description"),
        F.when((k % 11 == 0) | (k % 53 == 0), -quantity).otherwise(quantity).cast("int").alias("quantity"),
        (ordered + F.make_dt_interval(hours=(F.lit(6) + k % 15).cast("int"), mins=minutes.cast("int"))).alias(
            "invoice_date"
        ),
        F.when(pk % 601 == 3, F.lit(-1)).when(pk % 61 == 4, F.lit(0)).otherwise(listed).cast(MONEY).alias("price"),
        customer_id.cast("int").alias("customer_id"),
        F.when(k % 200 == 0, "EIRE").otherwise(F.col("n_name")).alias("country"),
        period.alias("period"),
        _copies(k, ln).alias("copy"),
    )
    other = F.when(F.col("period") == "P1", "P2").otherwise("P1")
    label = F.when(F.col("copy") == 2, other).otherwise(F.col("period"))
    return lines.select(
        "invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id", "country",
        label.alias("source_period"),
    )
