"""Queries from filings to values, ranks of ideas, savings, lots and analysis of funds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.stats import r6
from ledgerloom.operators import valuation
from ledgerloom.plans.bindings import BARS, STATEMENTS, bars, benchmark, statements
from ledgerloom.plans.registry import query, table

_ITEMS = "CASE item WHEN 'F' THEN 'eps' WHEN 'O' THEN 'cfo' ELSE 'capex' END"
_FILED = f"""{STATEMENTS}, q AS (SELECT security_id, {_ITEMS} AS item, 'Q' AS period_type, period_end, value, source, filed_at FROM statements),
  y AS (SELECT security_id, item, 'A' AS period_type, make_date(year(period_end), 12, 31) AS period_end, sum(value) AS value, source, max(filed_at) AS filed_at FROM q GROUP BY security_id, item, year(period_end), source),
  known AS (SELECT * FROM (SELECT * FROM q UNION ALL SELECT * FROM y) WHERE filed_at <= DATE '1996-03-31' AND period_end <= DATE '1996-03-31' QUALIFY row_number() OVER (PARTITION BY security_id, item, period_type, period_end ORDER BY filed_at DESC, source) = 1)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as items by quarter, and their sums by year, as known at a day."""
    quarters = statements(spark, sf_dir).withColumns({"item": F.expr("case item when 'F' then 'eps' when 'O' then 'cfo' else 'capex' end"), "period_type": F.lit("Q")})
    years = quarters.groupBy("security_id", "item", F.make_date(F.year("period_end"), F.lit(12), F.lit(31)).alias("period_end"), "source").agg(F.sum("value").alias("value"), F.max("filed_at").alias("filed_at")).withColumn("period_type", F.lit("A"))
    return valuation.known_figures(quarters.unionByName(years), F.lit("1996-03-31").cast("date"), ("source",))


@query(
    "val_facts",
    f"""WITH {_FILED}, k AS (SELECT * FROM known WHERE item = 'eps' AND period_type = 'Q' QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY period_end DESC) <= 4),
    t AS (SELECT security_id, CASE WHEN count(*) = 4 AND max(period_end) - min(period_end) BETWEEN 240 AND 300 THEN sum(value) END AS ttm FROM k GROUP BY 1),
    a AS (SELECT security_id, max_by(value, period_end) FILTER (item = 'eps' AND period_type = 'A') AS yearly, max_by(value, (period_end, CASE period_type WHEN 'A' THEN 1 ELSE 0 END)) FILTER (item = 'capex') AS capex, max_by(value, period_end) FILTER (item = 'cfo' AND period_type = 'A') AS cfo FROM known GROUP BY 1)
    SELECT security_id, round_even(coalesce(ttm, yearly), 2) AS eps, CASE WHEN ttm IS NOT NULL THEN 'ttm' WHEN yearly IS NOT NULL THEN 'last_annual' END AS eps_basis, round_even(capex, 2) AS capex, round_even(cfo, 2) AS cfo FROM a LEFT JOIN t USING (security_id)""",
)
def val_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = valuation.facts(_known(spark, sf_dir), ("capex",), ("cfo",))
    return found.withColumns({c: F.bround(c, 2) for c in ("eps", "capex", "cfo")})


@query(
    "val_cash_flow",
    f"""WITH {_FILED}, y2 AS (SELECT security_id, period_end, max(value) FILTER (item = 'cfo') AS cfo, max(value) FILTER (item = 'capex') AS capex FROM known WHERE period_type = 'A' GROUP BY 1, 2)
    SELECT security_id, max(period_end) AS period_end, round_even(max_by(cfo - abs(capex), period_end), 2) AS cash_flow FROM y2 WHERE cfo IS NOT NULL AND capex IS NOT NULL GROUP BY 1""",
)
def val_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuation.free_cash_flow(_known(spark, sf_dir)).withColumn("cash_flow", F.bround("cash_flow", 2))


SCENARIOS = {"bear": (0.02, 0.14, 0.02), "base": (0.08, 0.12, 0.03), "bull": (0.15, 0.11, 0.04)}
_CASH, _SHARES = "CASE WHEN p_partkey % 7 > 0 THEN p_retailprice * (p_partkey % 5 - 1) END", "CASE WHEN p_partkey % 11 > 0 THEN CAST(p_size AS DOUBLE) END"


def _factor(growth: float, discount: float, terminal: float) -> float:
    step = (1 + growth) / (1 + discount)
    return sum(step**k for k in range(1, 11)) + step**10 * (1 + terminal) / (discount - terminal)


@query(
    "val_range",
    f"WITH p AS (SELECT p_partkey, {_CASH} AS cash, {_SHARES} AS shares FROM part) SELECT p_partkey, " + ", ".join(f"round_even(CASE WHEN cash > 0 THEN cash * {_factor(*s)!r}::DOUBLE END, 4) AS {n}_equity, round_even(CASE WHEN cash > 0 THEN cash * {_factor(*s)!r}::DOUBLE / shares END, 4) AS {n}_per_share" for n, s in SCENARIOS.items())
    + f""", CASE WHEN cash IS NULL THEN 'no cash flow' WHEN cash <= 0 THEN 'cash flow is not positive' END AS reason,
    CASE WHEN cash IS NULL THEN 'no cash flow' WHEN cash <= 0 THEN 'cash flow is not positive' WHEN shares IS NULL THEN 'no market value' WHEN NOT (300 * shares BETWEEN cash * {_factor(-0.5, 0.12, 0.03)!r}::DOUBLE AND cash * {_factor(1.0, 0.12, 0.03)!r}::DOUBLE) THEN 'market value is out of the range of growth' END AS implied_reason FROM p""",
)
def val_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_CASH} as cash", f"{_SHARES} as shares")
    found = valuation.fair_range(F.col("cash"), F.col("shares"), F.lit(300.0), SCENARIOS, 10)
    return rows.select("p_partkey", *[(F.bround(c, 4) if n.endswith(("equity", "share")) else c).alias(n) for n, c in found.items() if n != "implied_growth_pct"])


_ESTIMATES = "e AS (SELECT user_id % 40 AS security_id, event_type AS period, CAST(ts AS DATE) AS as_of, max(floor(value) - 20) AS value FROM events GROUP BY ALL)"


@query(
    "revisions_metric",
    f"""WITH {_ESTIMATES}, k AS (SELECT * FROM e WHERE as_of <= DATE '2024-01-25'), n AS (SELECT security_id, max((as_of, period)) AS top FROM k GROUP BY 1),
    s AS (SELECT k.security_id, max(as_of) AS last, max_by(value, as_of) AS now, min(as_of) FILTER (as_of >= DATE '2024-01-18') AS first, min_by(value, as_of) FILTER (as_of >= DATE '2024-01-18') AS "then" FROM k JOIN n ON k.security_id = n.security_id AND k.period = n.top[2] GROUP BY 1)
    SELECT security_id, round_even(CASE WHEN first < last AND "then" <> 0 THEN (now / "then" - 1) * 100 END, 6) AS change_pct, CASE WHEN first IS NULL OR first = last THEN 'one snapshot' WHEN "then" = 0 THEN 'earlier estimate is zero' END AS reason FROM s""",
)
def revisions_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("security_id"), F.col("event_type").alias("period"), F.to_date("ts").alias("as_of")).agg(F.max(F.floor("value") - 20).cast("double").alias("value"))
    return valuation.revisions(rows, F.lit("2024-01-25").cast("date"), 7).withColumn("change_pct", r6(F.col("change_pct")))


@query(
    "fa_promoter",
    f"""WITH {STATEMENTS}, q AS (SELECT security_id, period_end, CASE WHEN count(*) % 5 > 0 THEN sum(value) / 1e6::DOUBLE END AS p, count(*)::DOUBLE AS g FROM statements GROUP BY 1, 2),
    l AS (SELECT *, lag(p, 4) OVER w AS b, row_number() OVER w AS n FROM q WINDOW w AS (PARTITION BY security_id ORDER BY period_end)), z AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY period_end DESC) = 1)
    SELECT security_id, g AS pledged_pct, round_even(p - b, 4) AS change_4q, CASE WHEN n < 5 THEN 'fewer than five quarters' WHEN p - b IS NULL THEN 'holding not reported' END AS reason FROM z""",
)
def fa_promoter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    rows = statements(spark, sf_dir).groupBy("security_id", "period_end").agg(F.when(n % 5 > 0, F.sum("value") / 1e6).alias("promoter_pct"), n.cast("double").alias("pledged_pct"))
    return valuation.owner_change(rows).withColumn("change_4q", F.bround("change_4q", 4))


@query(
    "id_rank",
    """WITH v AS (SELECT c_custkey AS security_id, c_mktsegment AS symbol, CASE c_custkey % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'ACCUMULATE' WHEN 2 THEN 'HOLD' ELSE 'SELL' END AS verdict, CASE c_custkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS conviction, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS composite, c_custkey % 10 = 0 AS vetoed FROM customer)
    SELECT security_id, conviction, composite, (row_number() OVER w)::INT AS place FROM v WHERE verdict IN ('BUY', 'ACCUMULATE') AND NOT vetoed WINDOW w AS (ORDER BY CASE conviction WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, composite DESC NULLS LAST, symbol, security_id) QUALIFY place <= 15""",
)
def id_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 best ideas."""
    verdicts = table(spark, sf_dir, "customer").selectExpr("c_custkey as security_id", "c_mktsegment as symbol", "case c_custkey % 4 when 0 then 'BUY' when 1 then 'ACCUMULATE' when 2 then 'HOLD' else 'SELL' end as verdict", "case c_custkey % 5 when 0 then 'high' when 1 then 'medium' when 2 then 'low' end as conviction", "if(c_custkey % 3 > 0, c_acctbal, null) as composite", "c_custkey % 10 = 0 as vetoed")
    return valuation.ranked_ideas(verdicts, 15).select("security_id", "conviction", "composite", "place")


@query(
    "mf_ter_cost",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 6 > 0 THEN (p_size % 20) / 10.0::DOUBLE END AS r, CASE WHEN p_partkey % 7 > 0 THEN (p_size % 13) / 10.0::DOUBLE END AS d, CASE WHEN p_partkey % 8 > 0 THEN p_retailprice END AS v FROM part),
    w AS (SELECT *, concat_ws(', ', CASE WHEN r IS NULL THEN 'regular ratio' END, CASE WHEN d IS NULL THEN 'direct ratio' END, CASE WHEN v IS NULL THEN 'value' END) AS lacks FROM p)
    SELECT p_partkey, round_even(CASE WHEN lacks = '' THEN r - d END, 6) AS gap_pct, round_even(CASE WHEN lacks = '' AND r - d > 0 THEN v * (r - d) / 100 END, 2) AS saved_a_year, CASE WHEN lacks <> '' THEN 'unknown: ' || lacks WHEN r - d <= 0 THEN 'direct is not cheaper' END AS reason FROM w""",
)
def mf_ter_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "if(p_partkey % 6 > 0, (p_size % 20) / 10.0D, null) as r", "if(p_partkey % 7 > 0, (p_size % 13) / 10.0D, null) as d", "if(p_partkey % 8 > 0, p_retailprice, null) as v")
    found = valuation.saving_of_direct(F.col("r"), F.col("d"), F.col("v"))
    return rows.select("p_partkey", r6(found["gap_pct"]).alias("gap_pct"), found["saved_a_year"].alias("saved_a_year"), found["reason"].alias("reason"))


@query(
    "mf_valued_lots",
    """WITH l AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS acquired, (o_orderkey % 9 + 1)::DOUBLE AS units, CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice / 1000 END AS unit_cost FROM orders), u AS (SELECT key, sum(units) AS units FROM l GROUP BY 1),
    s AS (SELECT key, CASE WHEN key % 10 > 0 THEN 20.0::DOUBLE + key % 9 END AS nav, CASE WHEN key % 4 = 0 THEN 'lots differ from the holding' WHEN key % 10 = 0 THEN 'no value a unit' WHEN key % 13 > 10 THEN 'value a unit is old' END AS reason FROM u)
    SELECT l.key, acquired, units, (DATE '2002-01-01' - acquired)::INT AS holding_days, round_even(CASE WHEN reason IS NULL THEN units * nav END, 6) AS value, round_even(CASE WHEN reason IS NULL THEN units * nav - units * unit_cost END, 6) AS gain, reason FROM l JOIN s ON s.key = l.key""",
)
def mf_valued_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2002-01-01").cast("date")
    lots = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("acquired"), (F.col("o_orderkey") % 9 + 1).cast("double").alias("units"), F.when(F.col("o_orderkey") % 6 > 0, F.col("o_totalprice") / 1000).alias("unit_cost"))
    held = lots.groupBy("key").agg(F.sum("units").alias("held"))
    known = held.select("key", (F.col("held") + F.when(F.col("key") % 4 == 0, 0.5).otherwise(0.0)).alias("held"), F.when(F.col("key") % 10 > 0, 20.0 + F.col("key") % 9).alias("nav"), F.date_sub(as_of, (F.col("key") % 13).cast("int")).alias("nav_date"))
    found = valuation.valued_lots(lots, known, as_of, 10)
    return found.withColumns({c: r6(F.col(c)) for c in ("value", "gain")})


@query(
    "mf_analyse",
    f"""WITH {BARS}, l AS (SELECT security_id AS fund, date, close AS nav, CASE WHEN day(date) % 5 >= right(security_id, 1)::INT - 3 THEN benchmark END AS b FROM bars JOIN bench USING (date)),
    r AS (SELECT fund, nav / lag(nav) OVER w - 1 AS f FROM l WINDOW w AS (PARTITION BY fund ORDER BY date)), d AS (SELECT fund, nav / lag(nav) OVER w - 1 AS f, b / lag(b) OVER w - 1 AS b FROM l WHERE b IS NOT NULL WINDOW w AS (PARTITION BY fund ORDER BY date)),
    c AS (SELECT fund, count(*) AS points, 100.0::DOUBLE * count(b) / count(*) AS coverage FROM l GROUP BY 1), s AS (SELECT fund, 100 * stddev_samp(f) * sqrt(252.0) AS sd FROM r GROUP BY 1), k AS (SELECT fund, 100 * avg(f) FILTER (b < 0) / avg(b) FILTER (b < 0) AS capture FROM d GROUP BY 1)
    SELECT fund, points, round_even(coverage, 6) AS coverage_pct, CASE WHEN coverage = 0 THEN 'no benchmark' WHEN coverage < 80 THEN 'benchmark covers too few days' END AS reason, round_even(sd, 6) AS std_pct, round_even(CASE WHEN coverage >= 80 THEN capture END, 6) AS downside_capture_pct FROM c LEFT JOIN s USING (fund) LEFT JOIN k USING (fund)""",
)
def mf_analyse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as funds; the more the benchmark lacks, the higher a brand's last digit."""
    levels = bars(spark, sf_dir).join(benchmark(spark, sf_dir), "date").select(F.col("security_id").alias("fund"), "date", F.col("close").alias("nav"), F.expr("if(day(date) % 5 >= cast(right(security_id, 1) as int) - 3, benchmark, null)").alias("benchmark"))
    found = valuation.analyse_funds(levels, 1095, 4.0)
    return found.select("fund", "points", r6(F.col("coverage_pct")).alias("coverage_pct"), "reason", r6(F.col("std_pct")).alias("std_pct"), r6(F.col("downside_capture_pct")).alias("downside_capture_pct"))
