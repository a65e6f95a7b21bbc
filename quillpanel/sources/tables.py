"""Entity x period panels built from the order tables.

Line items are first summed per order, then per customer and year, and only then joined
and rolled up, so that one hot order, customer or nation reaches every shuffle already
combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillpanel.functions.numeric import percent_of, ratio

SECTORS = {"s_urgent": "1-URGENT", "s_high": "2-HIGH", "s_medium": "3-MEDIUM", "s_low": "5-LOW"}
FIRST_PERIOD, LAST_PERIOD, LAST_FULL_PERIOD = 1995, 2001, 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customer_years(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of line items per (customer, year): one row per key, parts still additive."""
    one_if = lambda test: F.sum(F.when(test, 1).otherwise(0))
    per_order = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_extendedprice").alias("price"),
            F.sum("l_quantity").alias("quantity"),
            F.count(F.lit(1)).alias("lines"),
            one_if(F.col("l_returnflag") == "R").alias("returned"),
            one_if(F.col("l_linestatus") == "O").alias("open"),
        )
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("period"), "o_orderpriority"
    )
    sectors = [F.sum(F.when(F.col("o_orderpriority") == v, F.col("price"))).alias(k) for k, v in SECTORS.items()]
    return (
        per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
        .groupBy("o_custkey", "period")
        .agg(
            *[F.sum(c).alias(c) for c in ("price", "quantity", "lines", "returned", "open")],
            F.count(F.lit(1)).alias("orders"),
            *sectors,
        )
    )


def _millions(cents_exact: Column) -> Column:
    """A sum of prices in millions.  Prices are whole cents, so rounding the sum to cents removes only float
    noise, and equal amounts are equal numbers whatever the order of addition."""
    return F.round(cents_exact, 2) / 1e6


def _growth(df: DataFrame) -> DataFrame:
    by_entity = W.partitionBy("entity").orderBy("period")
    return df.withColumn("growth_pct", (ratio(F.col("base"), F.lag("base").over(by_entity)) - 1) * 100)


def nation_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (nation, year): totals, customer count, shares and sector parts."""
    years = customer_years(spark, folder)
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    panel = (
        years.join(customer, years.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_nationkey").alias("entity"), "period")
        .agg(
            _millions(F.sum("price")).alias("target"),
            F.sum("quantity").alias("base"),
            F.count(F.lit(1)).alias("population"),
            percent_of(F.sum("returned"), F.sum("lines")).alias("fossil_pct"),
            percent_of(F.sum("open"), F.sum("lines")).alias("renewable_pct"),
            *[_millions(F.sum(s)).alias(s) for s in SECTORS],
        )
    )
    return _growth(panel)


def customer_panel(spark: SparkSession, folder: str, first: int = FIRST_PERIOD, last: int = LAST_PERIOD) -> DataFrame:
    """One row per (customer, year) of the whole span; metrics are NULL where the customer ordered nothing."""
    grid = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("period")
    )
    metrics = customer_years(spark, folder).select(
        F.col("o_custkey").alias("entity"),
        "period",
        _millions(F.col("price")).alias("target"),
        F.col("quantity").alias("base"),
        F.col("orders").alias("population"),
        percent_of(F.col("returned"), F.col("lines")).alias("fossil_pct"),
        percent_of(F.col("open"), F.col("lines")).alias("renewable_pct"),
        *[_millions(F.col(s)).alias(s) for s in SECTORS],
    )
    return _growth(grid.join(metrics, ["entity", "period"], "left"))


def long_metrics(panel: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("entity", "period")) -> DataFrame:
    """Wide panel to (keys, indicator, value)."""
    doubles = [F.col(m).cast("double").alias(m) for m in metrics]
    return panel.select(*keys, *doubles).unpivot(list(keys), metrics, "indicator", "value")
