"""How the test tables stand for market data: brands are securities, days of shipping are sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.registry import table

def _unit():
    return F.col("l_extendedprice") / F.col("l_quantity")


def _decimal(name: str):
    return F.col(name).cast("decimal(18,2)")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, date, open, high, low, close, volume; the open is the close before."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("security_id"))
    close = F.sum(_decimal("l_extendedprice")).cast("double") / F.sum(_decimal("l_quantity")).cast("double")
    daily = lines.join(parts, "l_partkey").groupBy("security_id", "date").agg(close.alias("close"), F.max(_unit()).alias("high"), F.min(_unit()).alias("low"), F.sum(_decimal("l_quantity")).cast("double").alias("volume"))
    return daily.withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("security_id").orderBy("date")), F.col("close")))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close over all brands."""
    close = F.sum(_decimal("l_extendedprice")).cast("double") / F.sum(_decimal("l_quantity")).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(close.alias("benchmark"))


BARS = """
bars0 AS (
  SELECT p_brand AS security_id, CAST(l_shipdate AS DATE) AS date,
    sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS close,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
bars AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY security_id ORDER BY date), close) AS open FROM bars0),
bench AS (
  SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS benchmark
  FROM lineitem GROUP BY 1)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id (nation), period_end, item, value, source, filed_at, from orders by quarter."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    day = F.to_date("o_orderdate")
    quarter_end = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    lag = F.substring("o_orderpriority", 1, 1).cast("int")
    return orders.groupBy(F.col("c_nationkey").alias("security_id"), quarter_end.alias("period_end"), F.col("o_orderstatus").alias("item"), F.col("o_orderpriority").alias("source")).agg(F.sum(_decimal("o_totalprice")).cast("double").alias("value"), F.max(F.date_add(day, lag * 10)).alias("filed_at"))


STATEMENTS = """
statements AS (
  SELECT c_nationkey AS security_id, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end,
    o_orderstatus AS item, o_orderpriority AS source, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value,
    max(CAST(o_orderdate AS DATE) + CAST(left(o_orderpriority, 1) AS INT) * 10) AS filed_at
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""
