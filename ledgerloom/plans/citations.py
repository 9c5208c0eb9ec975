"""Queries over printed figures: orders as lines of a report, their prices and days as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import citations
from ledgerloom.plans.registry import query, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, block_id, scope, price, day, percent (a whole number), and the price in lakh, cut off after two decimals."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    hundredths = F.floor(price / 1000).cast("long")
    lakh = F.concat(F.expr("h div 100").cast("string"), F.lit("."), F.lpad((F.col("h") % 100).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("run_id"), F.col("o_orderkey").alias("block_id"), F.col("o_orderkey").cast("string").alias("scope"),
        price.alias("price"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 13).alias("percent"), hundredths.alias("h"),
    )
    return rows.withColumn("lakh", lakh).drop("h")


def report_blocks(orders: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Placed "), F.col("day").cast("string"), F.lit(", worth ₹"), "lakh", F.lit(" lakh, up "), F.col("percent").cast("string"), F.lit("% over SMA200."))
    return orders.select("run_id", "block_id", "scope", text.alias("text"))


@query(
    "ct_validate",
    """WITH o AS (
      SELECT o_custkey % 50 AS run_id, o_orderkey AS block_id, o_totalprice::DECIMAL(18,2) AS price, CAST(o_orderdate AS DATE) AS day, o_orderkey % 13 AS p,
        floor(o_totalprice::DECIMAL(18,2) / 1000)::BIGINT AS h FROM orders),
    t AS (SELECT *, (h // 100)::VARCHAR || '.' || lpad((h % 100)::VARCHAR, 2, '0') AS lakh, h / 100.0::DOUBLE AS v, block_id % 3 = 0 AS own FROM o),
    sums AS (SELECT run_id, list_sort(list(price::DOUBLE)) AS prices FROM o WHERE block_id % 7 <> 0 GROUP BY run_id),
    j AS (SELECT t.*, coalesce(prices, []) AS prices FROM t LEFT JOIN sums USING (run_id)),
    f AS (
      SELECT run_id, block_id, 1 AS n, day::VARCHAR AS figure, block_id % 5 <> 0 AS held FROM j
      UNION ALL SELECT run_id, block_id, 3, '₹' || lakh || ' lakh', len(list_filter(prices, lambda e: abs(e - h / 100.0::DOUBLE) <= 0.005 + 1e-9 OR abs(e - h * 1000.0::DOUBLE) <= 500 OR abs(e - h / 10000.0::DOUBLE) <= 0.00005 + 1e-12)) > 0
        OR own AND (abs(p / 100.0::DOUBLE - v) <= 0.005 + 1e-9 OR abs(p / 100.0::DOUBLE - v / 100) <= 0.00005 + 1e-12) FROM j
      UNION ALL SELECT run_id, block_id, 5, p::VARCHAR || '%', run_id = 7 OR own OR len(list_filter(prices, lambda e: abs(e - p) <= 0.5 OR abs(e - p / 100.0::DOUBLE) <= 0.005)) > 0 FROM j)
    SELECT run_id, block_id, n, figure, CASE WHEN run_id = 9 THEN 'cannot verify: some evidence was redacted' ELSE 'no evidence in the run' END AS reason FROM f WHERE NOT held""",
)
def ct_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of order lines that neither the run's prices nor the order's own day and percentage support."""
    orders = _orders(spark, sf_dir)
    none, everywhere = F.lit(None), F.lit(citations.EVERYWHERE)
    evidence = orders.where("block_id % 7 <> 0").select("run_id", everywhere.alias("scope"), F.col("price").cast(citations.NUMBER).alias("value"), none.cast("date").alias("day"))
    evidence = evidence.union(orders.where("block_id % 5 <> 0").select("run_id", "scope", none.cast(citations.NUMBER), "day"))
    evidence = evidence.union(orders.where("block_id % 3 = 0").select("run_id", "scope", (F.col("percent").cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(citations.NUMBER), none.cast("date")))
    registered = orders.where("run_id = 7").select("run_id", F.col("percent").alias("value"), F.lit(0).alias("decimals"), F.lit("%").alias("unit")).distinct()
    found = citations.unmatched(report_blocks(orders), evidence, registered, spark.range(9, 10).select(F.col("id").alias("run_id")))
    return found.select("run_id", "block_id", "n", "figure", "reason")


@query("ct_figures")
def ct_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and dates of whole documents; the forms need patterns that look around, which SQL here has not."""
    return citations.figures(table(spark, sf_dir, "documents").select("doc_id", "text"))
