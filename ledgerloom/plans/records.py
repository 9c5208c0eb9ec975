"""Queries over registers and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import records
from ledgerloom.plans.registry import query, table


@query("us_exchange_norm", """WITH l AS (SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN ' nyse  american ' WHEN 1 THEN 'Nasdaq' WHEN 2 THEN 'NYSEArca' WHEN 3 THEN 'amex' WHEN 4 THEN 'otc' END AS label FROM nation)
  SELECT n_nationkey, CASE upper(trim(regexp_replace(label, '\\s+', ' ', 'g'))) WHEN 'NYSE AMERICAN' THEN 'NYSE' WHEN 'NASDAQ' THEN 'NASDAQ' WHEN 'NYSEARCA' THEN 'ARCA' WHEN 'AMEX' THEN 'NYSE' END AS venue FROM l""")
def us_exchange_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case n_nationkey % 6 when 0 then ' nyse  american ' when 1 then 'Nasdaq' when 2 then 'NYSEArca' when 3 then 'amex' when 4 then 'otc' end")
    return table(spark, sf_dir, "nation").select("n_nationkey", records.venue(label).alias("venue"))


@query("mf_schemes", """WITH s AS (SELECT p_partkey AS security_id, p_partkey % 700 AS code, CASE WHEN p_partkey % 3 = 0 THEN p_type || ' IDCW' WHEN p_partkey % 3 = 1 THEN p_type || ' Reinvestment plan' ELSE p_type || ' Growth' END AS name FROM part)
  SELECT code, security_id, name FROM s QUALIFY row_number() OVER (PARTITION BY code ORDER BY regexp_matches(lower(name), '\\b(?:idcw|payout|dividend|reinvest\\w*)\\b'), security_id) = 1""")
def mf_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_type", F.expr("case p_partkey % 3 when 0 then ' IDCW' when 1 then ' Reinvestment plan' else ' Growth' end"))
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 700).alias("code"), F.col("p_partkey").alias("security_id"), name.alias("name"))
    return records.scheme_rows(rows)


@query("isin_resolver", """WITH s AS (SELECT c_custkey AS security_id, 'IN' || c_custkey % 1000 AS isin, c_custkey % 6 = 0 AS unresolved FROM customer), al AS (SELECT c_custkey AS security_id, 'OLD' || c_custkey % 900 AS isin FROM customer),
  q AS (SELECT DISTINCT isin FROM s UNION SELECT isin FROM al UNION SELECT 'XX1'), f AS (SELECT isin, security_id, 0 AS way FROM s WHERE NOT unresolved UNION ALL SELECT al.isin, al.security_id, 1 FROM al JOIN s ON s.security_id = al.security_id WHERE NOT unresolved)
  SELECT q.isin, min_by(security_id, (way, security_id)) AS security_id FROM q LEFT JOIN f ON f.isin = q.isin GROUP BY 1""")
def isin_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    securities = customers.select(F.col("c_custkey").alias("security_id"), F.concat(F.lit("IN"), F.col("c_custkey") % 1000).alias("isin"), (F.col("c_custkey") % 6 == 0).alias("unresolved"))
    aliases = customers.select(F.col("c_custkey").alias("security_id"), F.concat(F.lit("OLD"), F.col("c_custkey") % 900).alias("isin"))
    asked = securities.select("isin").union(aliases.select("isin")).union(spark.range(1).select(F.lit("XX1").alias("isin"))).distinct()
    return records.resolve_isins(asked, securities, aliases)


@query("corp_actions_read", """WITH a AS (SELECT DISTINCT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS ex_date, l_returnflag AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'split' ELSE 'dividend' END AS kind FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1997-01-01')
  SELECT *, (row_number() OVER (PARTITION BY security_id ORDER BY ex_date, CASE source WHEN 'R' THEN 1 ELSE 2 END, source, kind))::INT AS turn FROM a""")
def corp_actions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions since a day, in the order in which they are read."""
    since = table(spark, sf_dir, "lineitem").withColumn("ex_date", F.to_date("l_shipdate")).where("ex_date >= date '1997-01-01'")
    actions = since.select(F.col("l_suppkey").alias("security_id"), "ex_date", F.col("l_returnflag").alias("source"), F.expr("if(l_linenumber % 2 = 0, 'split', 'dividend')").alias("kind")).distinct()
    return records.numbered_actions(actions, ["R"])


_THESES = "SELECT o_orderkey AS thesis_id, o_custkey AS security_id, CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE 'active' END AS status, o_orderkey % 11 = 0 AS old FROM orders"


@query("thesis_save", f"""WITH t AS ({_THESES}), w AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY thesis_id) AS n FROM t WHERE NOT old AND status = 'active')
  SELECT thesis_id, security_id, status FROM w WHERE n > 1 OR security_id IN (SELECT security_id FROM t WHERE old AND status = 'active')""")
def thesis_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be saved, as its security has an active thesis."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("thesis_id"), F.col("o_custkey").alias("security_id"), F.expr("if(o_orderkey % 3 = 0, 'closed', 'active')").alias("status"), (F.col("o_orderkey") % 11 == 0).alias("old"))
    return records.refused_theses(rows.where("old").drop("old"), rows.where("not old").drop("old"))


@query("watch_add", """WITH z AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS low, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal + c_custkey % 3 - 1 END AS high FROM customer)
  SELECT c_custkey, CASE WHEN (low IS NULL) <> (high IS NULL) THEN 'one end missing' WHEN low <= 0 THEN 'not positive' WHEN low > high THEN 'ends reversed' END AS fault FROM z""")
def watch_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal") + F.col("c_custkey") % 3 - 1)
    return table(spark, sf_dir, "customer").select("c_custkey", records.zone_fault(low, high).alias("fault"))


@query("quota_state", """WITH c AS (SELECT event_type AS vendor, CAST(ts AS DATE) AS day, 1 AS calls, CASE WHEN value > 50 THEN 'manual' ELSE 'auto' END AS kind FROM events),
  l AS (SELECT event_type AS vendor, max_by(event_id % 400, event_id) FILTER (event_id % 4 > 0) AS daily, max_by(event_id % 3000, event_id) FILTER (event_id % 5 > 2) AS monthly FROM events WHERE event_type <> 'view' GROUP BY 1),
  u AS (SELECT vendor, count(*) FILTER (day = DATE '2024-01-20') AS used_today, count(*) FILTER (day >= DATE '2024-01-15' AND day < DATE '2024-02-15') AS used_month, count(*) FILTER (day >= DATE '2024-01-15' AND day < DATE '2024-02-15' AND kind = 'manual') AS manual_month FROM c GROUP BY 1)
  SELECT vendor, used_today, used_month, manual_month, daily, monthly, coalesce(used_today * 100 >= daily * 80, false) OR coalesce(used_month * 100 >= monthly * 80, false) AS warned FROM u LEFT JOIN l USING (vendor)""")
def quota_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    calls = events.select(F.col("event_type").alias("vendor"), F.to_date("ts").alias("day"), F.lit(1).cast("long").alias("calls"), F.expr("if(value > 50, 'manual', 'auto')").alias("kind"))
    limits = events.where("event_type <> 'view'").select(F.col("event_type").alias("vendor"), F.col("event_id").alias("id"), F.expr("if(event_id % 4 > 0, event_id % 400, null)").alias("daily"), F.expr("if(event_id % 5 > 2, event_id % 3000, null)").alias("monthly"))
    return records.quota_state(calls, limits, F.lit("2024-01-20").cast("date"), 15)


@query("job_rows", "WITH r AS (SELECT event_type AS job, CAST(ts AS DATE) AS trading_date, count(*) AS tries FROM events GROUP BY 1, 2) SELECT * FROM r QUALIFY rank() OVER (PARTITION BY job ORDER BY trading_date DESC) = 1")
def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("job"), F.to_date("ts").alias("trading_date")).agg(F.count("*").alias("tries"))
    return records.last_runs(runs)


@query("al_levels", "SELECT user_id AS security_id, max_by(value, event_id) AS level FROM events GROUP BY 1")
def al_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latest_levels(table(spark, sf_dir, "events").select(F.col("user_id").alias("security_id"), F.col("event_id").alias("id"), F.col("value").alias("level")))


@query("led_scored_keys", "SELECT DISTINCT o_custkey AS entry_id, year(o_orderdate)::INT AS horizon FROM orders WHERE o_orderstatus = 'F'")
def led_scored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry_id"), F.year("o_orderdate").alias("horizon"), F.expr("if(o_orderstatus = 'F', 'scored', 'pending')").alias("status"))
    return records.scored_keys(scores, ["entry_id", "horizon"])


@query("fund_holdings_month", """WITH h AS (SELECT l_suppkey AS fund, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_partkey AS isin, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS weight FROM lineitem GROUP BY ALL)
  SELECT fund, month, isin, weight, (row_number() OVER (PARTITION BY fund ORDER BY weight DESC, isin))::INT AS turn FROM h WHERE month = DATE '1997-05-01'""")
def fund_holdings_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdings of one month, as a reader of that month sees them."""
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("fund"), F.trunc(F.to_date("l_shipdate"), "month").alias("month"), F.col("l_partkey").alias("isin")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("weight"))
    return records.month_holdings(held, F.lit("1997-05-01").cast("date"))
