"""Queries over multiples in their own history: nations are companies, brands their prices, orders their filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import history
from ledgerloom.plans.bindings import BARS, bars
from ledgerloom.plans.registry import query, table

_ITEMS = ["eps", "shares_out", "total_equity", "total_debt", "cash", "operating_income", "depreciation_amortization", "cfo", "capex", "dividends_per_share", "revenue", "net_income"]


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, item, period_type, period_end, value, filed_at: quarters and years, each filed by up to five sources."""
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(nation, "o_custkey")
    item = F.get(F.array(*map(F.lit, _ITEMS)), (F.col("o_custkey") % 12).cast("int"))
    quarter_end = F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2))
    sign = F.when((F.col("c_nationkey") % 7 == 0) & (item == "eps") | (item == "capex") & (F.col("c_nationkey") % 2 == 1), -1).otherwise(1)
    after = F.substring("o_orderpriority", 1, 1).cast("int") * 20 - 25
    value = F.sum(sign * F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    quarters = orders.groupBy(F.col("c_nationkey").alias("security_id"), item.alias("item"), quarter_end.alias("period_end"), after.alias("after")).agg(value.alias("value")).withColumn("period_type", F.lit("Q"))
    years = orders.groupBy(F.col("c_nationkey").alias("security_id"), item.alias("item"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("period_end"), after.alias("after")).agg(value.alias("value")).withColumn("period_type", F.lit("A"))
    return quarters.unionByName(years).withColumn("filed_at", F.date_add("period_end", F.col("after"))).drop("after")


FILINGS = """
ordered AS (
  SELECT c_nationkey AS security_id, ['eps', 'shares_out', 'total_equity', 'total_debt', 'cash', 'operating_income', 'depreciation_amortization', 'cfo', 'capex', 'dividends_per_share', 'revenue', 'net_income'][o_custkey % 12 + 1] AS item,
    last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS quarter_end, make_date(year(o_orderdate), 12, 31) AS year_end,
    left(o_orderpriority, 1)::INT * 20 - 25 AS after, o_totalprice::DECIMAL(18,2) AS price
  FROM orders JOIN customer ON c_custkey = o_custkey),
signed AS (SELECT * REPLACE (CASE WHEN security_id % 7 = 0 AND item = 'eps' OR item = 'capex' AND security_id % 2 = 1 THEN -price ELSE price END AS price) FROM ordered),
filings AS (
  SELECT security_id, item, 'Q' AS period_type, quarter_end AS period_end, sum(price)::DOUBLE AS value, quarter_end + after AS filed_at FROM signed GROUP BY ALL
  UNION ALL SELECT security_id, item, 'A', year_end, sum(price)::DOUBLE, year_end + after FROM signed GROUP BY ALL)"""

_AT = f"""{FILINGS}, {BARS}, prices AS (SELECT replace(security_id, 'Brand#', '')::INT - 1 AS security_id, date, close FROM bars WHERE date <= DATE '2001-06-30'),
days AS (
  SELECT security_id, max(date) AS date, max_by(close, date) AS close, 'month' AS slot FROM prices GROUP BY security_id, date_trunc('month', date)
  UNION ALL SELECT security_id, DATE '2001-06-30', max_by(close, date), 'now' FROM prices GROUP BY security_id),
known AS (
  SELECT d.security_id, d.date, d.slot, d.close, f.* EXCLUDE (security_id) FROM days d LEFT JOIN filings f ON f.security_id = d.security_id AND f.filed_at <= d.date AND f.period_end <= d.date
  QUALIFY row_number() OVER (PARTITION BY d.security_id, d.slot, d.date, item, period_type, period_end ORDER BY filed_at DESC, value DESC) = 1),
quarters AS (
  SELECT * FROM known WHERE item = 'eps' AND period_type = 'Q' QUALIFY row_number() OVER (PARTITION BY security_id, slot, date ORDER BY period_end DESC) <= 4),
ttm AS (SELECT security_id, slot, date, sum(value) AS ttm FROM quarters GROUP BY ALL HAVING count(*) = 4 AND max(period_end) - min(period_end) BETWEEN 240 AND 300),
wide AS (
  SELECT security_id, slot, date, any_value(close) AS price, {", ".join(f"max_by(value, (period_end, CASE period_type WHEN 'A' THEN 1 ELSE 0 END)) FILTER (item = '{i}') AS {i}" for i in history.NEWEST)},
    {", ".join(f"max_by(value, period_end) FILTER (item = '{i}' AND period_type = 'A') AS {i}" for i in history.YEARLY)} FROM known GROUP BY ALL),
facts AS (
  SELECT w.* REPLACE (coalesce(ttm, eps) AS eps, abs(capex) AS capex), CASE WHEN ttm IS NOT NULL THEN 'ttm' WHEN eps IS NOT NULL THEN 'last_annual' END AS eps_basis, price * shares_out AS cap,
    CASE security_id % 2 WHEN 0 THEN 'IN' ELSE 'US' END AS market, security_id % 5 = 0 AS financial FROM wide w LEFT JOIN ttm USING (security_id, slot, date))"""


@query("val_facts_at", f"WITH {_AT} SELECT security_id, date, eps_basis, {', '.join(f'round_even({i}, 4) AS {i}' for i in (*history.NEWEST, *history.YEARLY))} FROM facts WHERE slot = 'month'")
def val_facts_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures known at each month end."""
    ends = closes(spark, sf_dir).where("date <= date'2001-06-30'").groupBy("security_id", (F.year("date") * 12 + F.month("date") - 1).alias("month")).agg(F.max("date").alias("date"))
    found = history.facts_at(filings(spark, sf_dir), ends)
    return found.select("security_id", "date", "eps_basis", *[F.bround(i, 4).alias(i) for i in (*history.NEWEST, *history.YEARLY)])


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select((F.replace("security_id", F.lit("Brand#")).cast("int") - 1).alias("security_id"), "date", "close")


_WINDOW = """count(*) FILTER (date > DATE '2001-06-30' - INTERVAL {n} YEAR) AS n{n}, min(date) FILTER (date > DATE '2001-06-30' - INTERVAL {n} YEAR) AS f{n},
  median(value) FILTER (date > DATE '2001-06-30' - INTERVAL {n} YEAR) AS m{n}, count(*) FILTER (date > DATE '2001-06-30' - INTERVAL {n} YEAR AND value <= current) AS b{n}"""
_SHOWN = """coalesce(n{n}, 0) AS observations_{n}y, CASE WHEN w{n} IS NULL THEN round_even(round_even(m{n}, 8), 6) END AS median_{n}y, CASE WHEN w{n} IS NULL AND current IS NOT NULL THEN round_even(round_even(100.0::DOUBLE * b{n} / n{n}, 8), 6) END AS percentile_{n}y,
  coalesce(w{n}, CASE WHEN current IS NULL THEN 'no current value' END) AS reason_{n}y"""
_WHY = "CASE WHEN coalesce(n{n}, 0) < 24 THEN 'too few observations' WHEN f{n} > CAST(DATE '2001-06-30' - INTERVAL {n} YEAR AS DATE) + 62 THEN 'history is shorter than the window' END AS w{n}"


TOLD = f"""{_AT}, cells AS (
      SELECT security_id, slot, date, unnest([
        {{'multiple': 'pe', 'value': CASE WHEN eps > 0 THEN price / eps END, 'why': CASE WHEN eps IS NULL THEN 'no eps filed' WHEN eps <= 0 THEN 'eps is not positive' END}},
        {{'multiple': 'pb', 'value': CASE WHEN total_equity > 0 THEN cap / total_equity END, 'why': CASE WHEN cap IS NULL THEN 'no shares_out filed' WHEN total_equity IS NULL THEN 'no total_equity filed' WHEN total_equity <= 0 THEN 'equity is not positive' END}},
        {{'multiple': 'ev_ebitda', 'value': CASE WHEN NOT financial AND market <> 'IN' AND operating_income + depreciation_amortization > 0 THEN (cap + total_debt - cash) / (operating_income + depreciation_amortization) END,
          'why': CASE WHEN financial THEN 'not meaningful for financials' WHEN cap IS NULL THEN 'no shares_out filed' WHEN market = 'IN' THEN 'operating income is after depreciation'
            WHEN operating_income IS NULL OR depreciation_amortization IS NULL OR total_debt IS NULL OR cash IS NULL THEN 'a part of EV or EBITDA is not filed' WHEN operating_income + depreciation_amortization <= 0 THEN 'EBITDA is not positive' END}},
        {{'multiple': 'fcf_yield_pct', 'value': CASE WHEN NOT financial THEN 100 * (cfo - capex) / cap END, 'why': CASE WHEN financial THEN 'not meaningful for financials' WHEN cap IS NULL THEN 'no shares_out filed' WHEN cfo IS NULL OR capex IS NULL THEN 'no cfo and capex filed' END}},
        {{'multiple': 'dividend_yield_pct', 'value': 100 * dividends_per_share / price, 'why': CASE WHEN dividends_per_share IS NULL THEN 'no dividends_per_share filed' END}}], recursive := true)
      FROM facts),
    now AS (SELECT security_id, multiple, round_even(value, 8) AS current, why AS reason FROM cells WHERE slot = 'now'),
    past AS (SELECT c.security_id, c.multiple, date, round_even(value, 8) AS value, current FROM cells c JOIN now USING (security_id, multiple) WHERE slot = 'month' AND value IS NOT NULL),
    counted AS (SELECT security_id, multiple, {_WINDOW.format(n=5)}, {_WINDOW.format(n=10)} FROM past GROUP BY 1, 2),
    told AS (SELECT now.*, counted.* EXCLUDE (security_id, multiple), {_WHY.format(n=5)}, {_WHY.format(n=10)} FROM now LEFT JOIN counted USING (security_id, multiple))"""


@query("val_history", f"""WITH {TOLD}
    SELECT security_id, multiple, round_even(current, 6) AS current, reason, {_SHOWN.format(n=5)}, {_SHOWN.format(n=10)} FROM told""")
def val_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.valuation_history(filings(spark, sf_dir), closes(spark, sf_dir), companies(spark, sf_dir), "2001-06-30")
    return found.withColumns({c: F.bround(c, 6) for c in found.columns if c.startswith(("current", "median", "percentile"))})


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("security_id"), F.when(F.col("n_nationkey") % 2 == 0, "IN").otherwise("US").alias("market"), F.when(F.col("n_nationkey") % 5 == 0, "financial").otherwise("general").alias("sector_kind"))
