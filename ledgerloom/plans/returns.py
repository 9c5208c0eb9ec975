"""Queries over rates, dated lots, money-weighted returns, sales of a year and taxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.stats import r6
from ledgerloom.operators import portfolio, returns
from ledgerloom.plans.registry import query, table

def _valuation() -> Column:
    return F.to_date(F.lit("2002-01-01"))

_LOTS = """lots AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS acquired, (o_orderkey % 7 + 1)::DOUBLE AS quantity, o_totalprice AS cost FROM orders),
  sums AS (SELECT key, sum(quantity) AS covered FROM lots GROUP BY 1),
  held AS (SELECT c_custkey AS key, c_nationkey AS portfolio, covered, CASE c_custkey % 9 WHEN 0 THEN 0 ELSE abs(c_acctbal) * 60 END AS price, DATE '2002-01-01' - (c_custkey % 13)::INT AS price_date,
    coalesce(covered, 0) + CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS held FROM customer LEFT JOIN sums ON key = c_custkey),
  states AS (SELECT *, CASE WHEN covered IS NULL THEN 'none' WHEN covered = held THEN 'exact' WHEN covered < held THEN 'partial' ELSE 'over' END AS state,
    CASE WHEN price > 0 AND DATE '2002-01-01' - price_date <= 10 THEN price END AS usable FROM held),
  flows AS (SELECT l.key, acquired AS date, -quantity * cost AS amount FROM lots l JOIN states s ON s.key = l.key WHERE state IN ('exact', 'partial') AND usable IS NOT NULL
    UNION ALL SELECT key, DATE '2002-01-01', covered * usable FROM states WHERE state IN ('exact', 'partial') AND usable IS NOT NULL)"""


def _npv(rate: str) -> str:
    return f"list_sum(list_transform(f, lambda x: x.a / pow(1 + {rate}, x.t)))"


def _xirr_sql(flows: str, key: str) -> str:
    """Tables ending in ``rates`` (key, rate, reason): the same bisection as steps of a recursion."""
    return f"""f0 AS (SELECT {key} AS key, date, amount, min(date) OVER (PARTITION BY {key}) AS d0 FROM {flows} WHERE amount <> 0),
  f1 AS (SELECT key, list(struct_pack(t := (date - d0) / 365.0::DOUBLE, a := amount) ORDER BY date, amount) AS f, min(date) < max(date) AS apart, min(amount) < 0 AND max(amount) > 0 AS signs FROM f0 GROUP BY 1),
  f2 AS (SELECT *, CASE WHEN apart AND signs THEN list_filter(list_transform(range(8), lambda k: 100.0::DOUBLE * pow(10, k)), lambda t: {_npv('(-0.999999::DOUBLE)')} * {_npv('t')} <= 0)[1] END AS top FROM f1),
  step AS (SELECT key, f, -0.999999::DOUBLE AS lo, top AS hi, 0 AS n FROM f2 WHERE top IS NOT NULL
    UNION ALL SELECT key, f, CASE WHEN same THEN m ELSE lo END, CASE WHEN same THEN hi ELSE m END, n + 1 FROM (SELECT *, (lo + hi) / 2 AS m, {_npv('lo')} * {_npv('((lo + hi) / 2)')} > 0 AS same FROM step WHERE n < 100)),
  rates AS (SELECT f2.key, (lo + hi) / 2 AS rate, CASE WHEN NOT signs THEN 'flows have one sign' WHEN NOT apart THEN 'flows fall on one day' WHEN top IS NULL THEN 'no rate brackets the flows' END AS reason
    FROM f2 LEFT JOIN step ON step.key = f2.key AND step.n = 100)"""


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("acquired"), (F.col("o_orderkey") % 7 + 1).cast("double").alias("quantity"), F.col("o_totalprice").alias("cost"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as securities in a nation's portfolio; some hold more or less than their lots, or have an old price or none."""
    sums = _lots(spark, sf_dir).groupBy("key").agg(F.sum("quantity").alias("covered"))
    more = F.expr("case c_custkey % 4 when 0 then 1 when 1 then -1 else 0 end")
    both = table(spark, sf_dir, "customer").join(sums, F.col("key") == F.col("c_custkey"), "left")
    return both.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("portfolio"), (F.coalesce("covered", F.lit(0.0)) + more).alias("held"), F.when(F.col("c_custkey") % 9 == 0, 0.0).otherwise(F.abs("c_acctbal") * 60).alias("price"), F.date_sub(_valuation(), (F.col("c_custkey") % 13).cast("int")).alias("price_date"))


@query("rt_xirr", f"""WITH RECURSIVE paid AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, o_totalprice AS amount FROM orders),
  flows AS (SELECT o_custkey, date, -amount AS amount FROM paid UNION ALL SELECT o_custkey, max(date) + 30, 1.2::DOUBLE * sum(amount) FROM paid GROUP BY 1), {_xirr_sql('flows', 'o_custkey')}
  SELECT key AS o_custkey, round_even(rate, 5) AS rate, reason FROM rates""")
def rt_xirr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payments; 30 days after the last one 1.2 times what was paid comes back."""
    paid = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("amount"))
    back = paid.groupBy("o_custkey").agg(F.date_add(F.max("date"), 30).alias("date"), (1.2 * F.sum("amount")).alias("amount"))
    found = portfolio.xirr(paid.withColumn("amount", -F.col("amount")).unionByName(back), "o_custkey")
    return found.select("o_custkey", F.bround("rate", 5).alias("rate"), "reason")


@query("rt_lot_report", f"""WITH RECURSIVE {_LOTS}, {_xirr_sql('flows', 'key')}
  SELECT s.key, state, round_even(rate, 5) AS rate, CASE WHEN state = 'none' THEN 'no lot dates' WHEN state = 'over' THEN 'lots exceed the holding' WHEN usable IS NULL THEN 'no recent price' ELSE reason END AS reason FROM states s LEFT JOIN rates r ON r.key = s.key""")
def rt_lot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.lot_report(_lots(spark, sf_dir), _held(spark, sf_dir), _valuation()).withColumn("rate", F.bround("rate", 5))


@query("xr_returns", f"""WITH RECURSIVE {_LOTS}, pooled AS (SELECT portfolio, date, sum(amount) AS amount FROM flows JOIN states USING (key) WHERE state = 'exact' GROUP BY 1, 2), {_xirr_sql('pooled', 'portfolio')},
  v AS (SELECT portfolio, sum(held * price) AS total, sum(held * price) FILTER (state = 'exact') AS exact FROM states GROUP BY 1)
  SELECT v.portfolio, round_even(rate, 5) AS rate, CASE WHEN exact IS NULL THEN 'no holding has exact lots' ELSE reason END AS reason, round_even(CASE WHEN total <> 0 THEN 100 * coalesce(exact, 0) / total END, 6) AS coverage_pct FROM v LEFT JOIN rates ON key = v.portfolio""")
def xr_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots, held = _lots(spark, sf_dir), _held(spark, sf_dir)
    states = returns.lot_states(lots, held, _valuation()).select("key", "state").join(held.select("key", "portfolio", (F.col("held") * F.col("price")).alias("value")), "key")
    flows = returns.lot_flows(lots, held, _valuation()).join(held.select("key", "portfolio"), "key")
    found = returns.pooled_return(flows, states)
    return found.select("portfolio", F.bround("rate", 5).alias("rate"), "reason", r6(F.col("coverage_pct")).alias("coverage_pct"))


@query("rt_lot_lines", f"WITH {_LOTS} SELECT key, acquired, quantity, (DATE '2002-01-01' - acquired)::INT AS holding_days, DATE '2002-01-01' - acquired >= 1500 AS long_term FROM lots")
def rt_lot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.lot_lines(_lots(spark, sf_dir), _valuation(), 1500).drop("cost")


_RATES = "usd AS (SELECT CAST(o_orderdate AS DATE) AS date, 70 + max(o_orderkey % 50) / 10.0::DOUBLE AS rate FROM orders WHERE day(o_orderdate) % 4 = 0 GROUP BY 1 UNION ALL SELECT DATE '2001-12-10', 75.5::DOUBLE)"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some days of each month, and one before the valuation."""
    day = F.to_date("o_orderdate")
    seen = table(spark, sf_dir, "orders").where(F.dayofmonth(day) % 4 == 0).groupBy(day.alias("date")).agg((70 + F.max(F.col("o_orderkey") % 50) / 10.0).alias("rate"))
    return seen.unionByName(spark.range(1).select(F.to_date(F.lit("2001-12-10")).alias("date"), F.lit(75.5).alias("rate")))


@query("fx_convert", f"""WITH {_RATES}, h AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice AS value, CASE WHEN o_custkey % 3 > 0 THEN 'USD' ELSE 'INR' END AS currency FROM orders),
  j AS (SELECT h.*, usd.date AS seen, CASE WHEN currency = 'USD' AND day - usd.date <= 7 THEN usd.rate END AS rate FROM h ASOF LEFT JOIN usd ON h.day >= usd.date)
  SELECT o_orderkey, currency, round_even(rate, 6) AS rate, rate IS NOT NULL AND day - seen > 5 AS stale, round_even(CASE WHEN currency = 'USD' THEN value * rate ELSE value END, 4) AS value_home FROM j""")
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("value"), F.expr("if(o_custkey % 3 > 0, 'USD', 'INR')").alias("currency"))
    found = returns.convert(held, _rates(spark, sf_dir), "day", stale_days=5, oldest=7)
    return found.select("o_orderkey", "currency", r6(F.col("rate")).alias("rate"), "stale", F.bround("value_home", 4).alias("value_home"))


@query("rt_lot_flows_inr", f"""WITH {_LOTS}, {_RATES}, j AS (SELECT f.key, f.date, CASE WHEN f.date - usd.date <= CASE WHEN f.date = DATE '2002-01-01' THEN 30 ELSE 7 END THEN amount * rate END AS amount FROM flows f ASOF LEFT JOIN usd ON f.date >= usd.date)
  SELECT key, date, round_even(amount, 4) AS amount FROM j QUALIFY count(*) FILTER (amount IS NULL) OVER (PARTITION BY key) = 0""")
def rt_lot_flows_inr(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = returns.lot_flows(_lots(spark, sf_dir), _held(spark, sf_dir), _valuation())
    return returns.home_flows(flows, _rates(spark, sf_dir), _valuation()).withColumn("amount", F.bround("amount", 4))


@query("ytd_sold", """WITH d AS (SELECT o_orderkey % 1000 AS entry_id, CAST(o_orderdate AS DATE) AS on_date, CASE o_orderstatus WHEN 'P' THEN 'skipped' WHEN 'F' THEN 'acted' ELSE 'partial' END AS decision, (o_orderkey % 9)::DOUBLE AS qty, CASE WHEN o_orderkey % 8 > 0 THEN o_totalprice END AS price, CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'INR' END AS currency FROM orders)
  SELECT round_even(coalesce(sum(coalesce(qty * price, 0) * CASE WHEN currency = 'USD' THEN 83.5::DOUBLE ELSE 1 END), 0), 0) AS amount, count(*) AS rows FROM d WHERE decision <> 'skipped' AND year(on_date) = 1996 AND entry_id % 5 IN (1, 2)""")
def ytd_sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 1000 as entry_id", "to_date(o_orderdate) as on_date", "case o_orderstatus when 'P' then 'skipped' when 'F' then 'acted' else 'partial' end as decision", "cast(o_orderkey % 9 as double) as qty", "if(o_orderkey % 8 > 0, o_totalprice, null) as price", "if(o_custkey % 2 = 0, 'USD', 'INR') as currency")
    calls = spark.range(1000).select(F.col("id").alias("entry_id"), F.expr("case id % 5 when 1 then 'SELL' when 2 then 'TRIM' else 'BUY' end").alias("verdict"))
    return returns.sold_in_year(decisions, calls, 1996, 83.5).withColumn("amount", F.bround("amount", 0))


@query("mf_tax_impact", f"""WITH {_LOTS}, g AS (SELECT key, DATE '2002-01-01' - acquired AS days, CASE WHEN key % 6 > 0 THEN quantity * (cost - 90000) END AS gain FROM lots),
  t AS (SELECT *, CASE WHEN gain IS NOT NULL AND days >= 1500 THEN greatest(gain, 0) * 12.5::DOUBLE / 100 END AS tax, CASE WHEN gain IS NULL THEN 'gain unknown' WHEN days < 1500 THEN 'short-term rate not set' END AS why FROM g)
  SELECT key, round_even(CASE WHEN count(gain) = count(*) THEN sum(gain) END, 4) AS gain, round_even(CASE WHEN count(tax) = count(*) THEN sum(tax) END, 4) AS tax, min(why) AS reason FROM t GROUP BY 1""")
def mf_tax_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = returns.lot_lines(_lots(spark, sf_dir), _valuation(), None).withColumn("gain", F.when(F.col("key") % 6 > 0, F.col("quantity") * (F.col("cost") - 90000)))
    found = returns.tax_impact(lots, 1500, None, 12.5)
    return found.select("key", F.bround("gain", 4).alias("gain"), F.bround("tax", 4).alias("tax"), "reason")
