"""Queries over named metrics and screens that read stored bars and filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import registry
from ledgerloom.operators.screening import Rule
from ledgerloom.plans.bindings import bars, benchmark
from ledgerloom.plans.history import TOLD, closes, companies, filings
from ledgerloom.plans.registry import query

AS_OF = "2001-06-30"
NAMES = ["price_vs_sma200_pct", "roc_6m", "rs_benchmark_change_6m_pct", "rs_percentile", "roe", "debt_equity", "eps_cagr", "pe", "pb", "market_cap", "valuation_percentile", "pe_vs_peer_median_pct", "revisions"]
RULES = [Rule("above_200dma", "price_vs_sma200_pct", ">", -5, True), Rule("strength", "rs_percentile", ">=", 30), Rule("business", "roe", ">=", 10, True), Rule("cheap", "valuation_percentile", "<=", 90), Rule("not_cut", "revisions", ">=", 0)]


def inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    daily = bars(spark, sf_dir).withColumn("security_id", F.replace("security_id", F.lit("Brand#")).cast("int") - 1)
    return {"bars": daily, "benchmark": benchmark(spark, sf_dir), "statements": filings(spark, sf_dir), "closes": closes(spark, sf_dir), "securities": companies(spark, sf_dir)}


_METRICS = f"""{TOLD},
  sm AS (SELECT security_id, close, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k, lag(close, 126) OVER (PARTITION BY security_id ORDER BY date) AS c126,
    CASE WHEN count(*) OVER h = 200 THEN avg(close) OVER h END AS a FROM prices WINDOW h AS (PARTITION BY security_id ORDER BY date ROWS 199 PRECEDING)),
  rr AS (SELECT security_id, date, close / benchmark AS ratio FROM prices JOIN bench USING (date)),
  rc AS (SELECT security_id, 100 * (ratio / lag(ratio, 126) OVER (PARTITION BY security_id ORDER BY date) - 1) AS change, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM rr),
  rs AS (SELECT security_id, change, CASE WHEN change IS NOT NULL THEN 100.0::DOUBLE * (count(change) OVER (ORDER BY change) - 0.5::DOUBLE * count(change) OVER (PARTITION BY change)) / count(change) OVER () END AS pct FROM rc WHERE k = 1),
  book AS (SELECT security_id, item, period_end, value, max(CASE WHEN item IN ('revenue', 'net_income') THEN period_end END) OVER (PARTITION BY security_id) AS fy FROM known WHERE slot = 'now' AND period_type = 'A'),
  yr AS (SELECT security_id, max(value) FILTER (item = 'net_income' AND period_end = fy) AS ni, max(value) FILTER (item = 'total_equity' AND period_end = fy) AS eq, max(value) FILTER (item = 'total_debt' AND period_end = fy) AS debt,
    max_by(value, period_end) FILTER (item = 'total_equity' AND period_end < fy) AS opening FROM book GROUP BY 1),
  ep AS (SELECT security_id, period_end, value, row_number() OVER (PARTITION BY security_id ORDER BY period_end DESC) AS k FROM book WHERE item = 'eps'),
  gr AS (SELECT security_id, max(value) FILTER (k = 1) AS v1, max(value) FILTER (k = 4) AS v0, max(period_end) FILTER (k = 1) - max(period_end) FILTER (k = 4) AS span FROM ep GROUP BY 1),
  va AS (SELECT security_id, max(current) FILTER (multiple = 'pe') AS pe, max(current) FILTER (multiple = 'pb') AS pb,
    coalesce(max(CASE WHEN w5 IS NULL AND current IS NOT NULL THEN round_even(100.0::DOUBLE * b5 / n5, 8) END) FILTER (multiple = 'pe'), max(CASE WHEN w5 IS NULL AND current IS NOT NULL THEN round_even(100.0::DOUBLE * b5 / n5, 8) END) FILTER (multiple = 'pb')) AS pct FROM told GROUP BY 1),
  pm AS (SELECT security_id % 5 = 0 AS financial, median(pe) AS med FROM va WHERE pe IS NOT NULL GROUP BY 1),
  mx AS (SELECT n.n_nationkey AS security_id, 100 * (sm.close / sm.a - 1) AS price_vs_sma200_pct, sm.close / sm.c126 - 1 AS roc_6m, rs.change AS rs_benchmark_change_6m_pct, rs.pct AS rs_percentile,
    CASE WHEN eq > 0 AND opening > 0 THEN 100 * ni / ((eq + opening) / 2) END AS roe, CASE WHEN eq > 0 THEN debt / eq END AS debt_equity,
    CASE WHEN span BETWEEN 990 AND 1200 AND v0 > 0 AND v1 > 0 THEN 100 * (pow(v1 / v0, 1.0::DOUBLE / 3) - 1) END AS eps_cagr, va.pe, va.pb, facts.cap AS market_cap, va.pct AS valuation_percentile, 100 * (va.pe / pm.med - 1) AS pe_vs_peer_median_pct
    FROM nation n LEFT JOIN sm ON sm.security_id = n.n_nationkey AND sm.k = 1 LEFT JOIN rs ON rs.security_id = n.n_nationkey LEFT JOIN yr ON yr.security_id = n.n_nationkey LEFT JOIN gr ON gr.security_id = n.n_nationkey
    LEFT JOIN va ON va.security_id = n.n_nationkey LEFT JOIN facts ON facts.security_id = n.n_nationkey AND facts.slot = 'now' LEFT JOIN pm ON pm.financial = (n.n_nationkey % 5 = 0))"""


@query("mx_metric_values", f"WITH {_METRICS} SELECT security_id, {', '.join(f'round_even({n}, 4) AS {n}' for n in NAMES[:-1])}, NULL::DOUBLE AS revisions, 'estimates not loaded' AS why_revisions FROM mx")
def mx_metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of five bundles; those of estimates aren't loaded."""
    stored = inputs(spark, sf_dir)
    found = registry.metric_values(stored["securities"], stored, NAMES, AS_OF)
    return found.select("security_id", *[F.bround(n, 4).alias(n) for n in NAMES], "why_revisions")


@query(
    "scr_stored",
    f"""WITH {_METRICS} SELECT security_id, CASE WHEN coalesce(price_vs_sma200_pct <= -5, true) THEN 'above_200dma' WHEN rs_percentile < 30 THEN 'strength' WHEN coalesce(roe < 10, true) THEN 'business' WHEN valuation_percentile > 90 THEN 'cheap' END AS failed,
      coalesce(price_vs_sma200_pct > -5, false) AND coalesce(rs_percentile >= 30, true) AND coalesce(roe >= 10, false) AND coalesce(valuation_percentile <= 90, true) AS matched FROM mx""",
)
def scr_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A screen from bars and filings; its last rule has no data and is skipped."""
    stored = inputs(spark, sf_dir)
    return registry.run_screen(stored["securities"], stored, RULES, AS_OF).select("security_id", "failed", "matched")


@query("scr_presets")
def scr_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example screens; flags and estimates aren't loaded, so two of them match nothing."""
    stored = inputs(spark, sf_dir)
    screens = [registry.run_screen(stored["securities"], stored, rules, AS_OF).select("security_id", F.lit(name).alias("preset"), "matched", "failed") for name, rules in registry.PRESETS.items()]
    out = screens[0]
    for one in screens[1:]:
        out = out.unionByName(one)
    return out
