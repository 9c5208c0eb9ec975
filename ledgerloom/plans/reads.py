"""Queries over stored rows: versions, snapshots, pages, forms, month ends, superseded figures, lateness, review rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import pit, review, stored
from ledgerloom.plans.bindings import BARS, bars
from ledgerloom.plans.registry import query, table

_POINTS = "points AS (SELECT user_id AS security_id, event_type AS metric, CAST(ts AS DATE) AS as_of, max(value) AS value FROM events GROUP BY ALL)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("security_id"), F.col("event_type").alias("metric"), F.to_date("ts").alias("as_of")).agg(F.max("value").alias("value"))


@query(
    "pit_shareholding",
    """WITH h AS (SELECT l_partkey AS security_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, l_returnflag AS source, CAST(l_shipdate AS DATE) AS filed_at, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY ALL)
    SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY security_id, quarter ORDER BY CASE source WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, filed_at DESC, source) = 1""",
)
def pit_shareholding(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("security_id"), F.to_date(F.date_trunc("quarter", day)).alias("quarter"), F.col("l_returnflag").alias("source"), day.alias("filed_at")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("value"))
    return stored.best_version(held, ["security_id", "quarter"], "source", ["N", "A"])


@query("latest_estimates", f"WITH {_POINTS} SELECT * FROM points WHERE as_of <= DATE '2024-01-15' QUALIFY row_number() OVER (PARTITION BY security_id, metric ORDER BY as_of DESC) = 1")
def latest_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.latest_as_of(_points(spark, sf_dir), ["security_id", "metric"], F.lit("2024-01-15").cast("date"), "as_of")


@query("estimate_history", f"WITH {_POINTS} SELECT * FROM points WHERE as_of BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def estimate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).where(F.col("as_of").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")))


@query(
    "fund_meta_pair",
    f"""WITH {_POINTS} SELECT security_id, metric, as_of, value, lag(as_of) OVER w AS before_as_of, lag(value) OVER w AS before_value FROM points WHERE as_of <= DATE '2024-01-25' WINDOW w AS (PARTITION BY security_id, metric ORDER BY as_of)
    QUALIFY row_number() OVER (PARTITION BY security_id, metric ORDER BY as_of DESC) = 1""",
)
def fund_meta_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.newest_and_before(_points(spark, sf_dir), ["security_id", "metric"], "as_of", ["value"], "2024-01-25")


@query("news_page", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def news_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.page(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 25, 50).select("event_id", "event_type", "value")


@query("list_filings", "SELECT o_custkey AS security_id, o_orderkey AS filing_id, left(o_orderpriority, 1) AS form, count(*) OVER (PARTITION BY o_custkey, left(o_orderpriority, 1)) AS versions FROM orders")
def list_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings by form, with amendments (finished orders) under the form that they amend."""
    form = F.concat(F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderstatus") == "F", "/A").otherwise(""))
    filed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("security_id"), F.col("o_orderkey").alias("filing_id"), stored.base_form(form).alias("form"))
    versions = filed.groupBy("security_id", "form").agg(F.count("*").alias("versions"))
    return filed.join(versions, ["security_id", "form"])


@query(
    "price_on_month_end",
    f"""WITH {BARS}, s AS (SELECT security_id, CAST(date_trunc('month', min(date)) AS DATE) AS a, max(date) AS b FROM bars GROUP BY 1),
    d AS (SELECT security_id, last_day(CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM s),
    f AS (SELECT d.security_id, d.month_end, b.date, b.close FROM d ASOF JOIN bars b ON d.security_id = b.security_id AND d.month_end >= b.date)
    SELECT security_id, month_end, date, close FROM f WHERE month_end - date <= 10""",
)
def price_on_month_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bars(spark, sf_dir).select("security_id", "date", "close")
    days = own.groupBy("security_id").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("security_id", F.explode(F.sequence(F.trunc("a", "month"), "b", F.expr("INTERVAL 1 MONTH"))).alias("m")).select("security_id", F.last_day("m").alias("month_end"))
    return stored.price_on_month_end(own, days)


@query(
    "sink_supersede",
    """WITH r AS (SELECT o_custkey AS security_id, year(o_orderdate)::INT AS year, o_orderpriority AS source, o_orderstatus AS status, o_totalprice AS value FROM orders),
    gone AS (SELECT DISTINCT security_id, year, source FROM r WHERE status = 'P' AND source IN ('1-URGENT', '2-HIGH'))
    SELECT security_id, year, source, value FROM r WHERE status = 'P' UNION ALL SELECT r.security_id, r.year, r.source, value FROM r ANTI JOIN gone USING (security_id, year, source) WHERE status <> 'P'""",
)
def sink_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("security_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("source"), "o_orderstatus", F.col("o_totalprice").alias("value"))
    old, new = rows.where("o_orderstatus <> 'P'").drop("o_orderstatus"), rows.where("o_orderstatus = 'P'").drop("o_orderstatus")
    return stored.supersede(old, new, ["security_id", "year"], ["1-URGENT", "2-HIGH"])


@query(
    "sch_classify_late",
    "SELECT event_id, CASE WHEN ts - date_trunc('hour', ts) > INTERVAL 30 MINUTE THEN 'missed' WHEN ts - date_trunc('hour', ts) > INTERVAL 10 MINUTE THEN 'late' ELSE 'on_time' END AS state FROM events",
)
def sch_classify_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select("event_id", stored.lateness(F.col("ts"), F.date_trunc("hour", "ts"), 10, 0.5).alias("state"))


@query(
    "rt_coverage_state",
    """WITH l AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity::DECIMAL(18,2)) AS covered FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN coalesce(covered, 0) = 0 THEN 'none' WHEN covered < 100 THEN 'partial' WHEN covered = 100 THEN 'exact' ELSE 'over' END AS state FROM orders LEFT JOIN l USING (o_orderkey)""",
)
def rt_coverage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("covered"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lots, "o_orderkey", "left").select("o_orderkey", stored.cover(F.col("covered"), F.lit(100)).alias("state"))


_FACTS = {
    "met": "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 13 = 0 AS INT) END", "unknown": "CAST(o_orderkey % 5 = 0 AS INT)", "revenue_falls": "CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 2 = 0 END", "margin_falls": "CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 3 = 0 END",
    "percentile": "CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice / 3000 END", "revisions": "CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderkey % 7 - 3 AS DOUBLE) END", "position": "CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey % 12 AS DOUBLE) END", "max_position": "10.0", "sector": "CASE WHEN o_orderkey % 14 <> 0 THEN CAST(o_custkey % 40 AS DOUBLE) END", "max_sector": "30.0",
    "positional": "o_orderstatus = 'O'", "below": "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 20 AS INT) END", "rs_change": "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 5 - 2 AS DOUBLE) END",
}


@query(
    "rv_triggers",
    f"""WITH f AS (SELECT o_orderkey, {', '.join(f'{e} AS {n}' for n, e in _FACTS.items())} FROM orders)
    SELECT o_orderkey, CASE WHEN met IS NULL THEN 'not_evaluable' WHEN met > 0 THEN 'triggered' WHEN unknown > 0 THEN 'not_evaluable' ELSE 'clear' END AS thesis,
      CASE WHEN revenue_falls IS NULL OR margin_falls IS NULL THEN 'not_evaluable' WHEN revenue_falls AND margin_falls THEN 'triggered' ELSE 'clear' END AS operations,
      CASE WHEN percentile IS NULL THEN 'not_evaluable' WHEN percentile <= 80 THEN 'clear' WHEN revisions IS NULL THEN 'not_evaluable' WHEN revisions <= 0 THEN 'triggered' ELSE 'clear' END AS valuation,
      CASE WHEN position > max_position OR sector > max_sector THEN 'triggered' WHEN position IS NULL OR sector IS NULL THEN 'not_evaluable' ELSE 'clear' END AS limits,
      CASE WHEN NOT "positional" THEN 'not_applicable' WHEN below IS NULL THEN 'not_evaluable' WHEN below < 10 THEN 'clear' WHEN rs_change IS NULL THEN 'not_evaluable' WHEN rs_change < 0 THEN 'triggered' ELSE 'clear' END AS trend,
      'not_evaluable' AS alternative FROM f""",
)
def rv_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[f"{e} as `{n}`" for n, e in _FACTS.items()])
    found = review.triggers({n: F.col(n) for n in _FACTS}, 80.0, 10)
    return facts.select("o_orderkey", *[v.alias(n) for n, v in found.items()])
