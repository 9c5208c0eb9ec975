"""Queries over funds: brands' closes are net asset values, parts are schemes, customers are candidates and holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.stats import r6
from ledgerloom.operators import funds
from ledgerloom.plans.bindings import BARS, bars, benchmark
from ledgerloom.plans.registry import query, table


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).join(benchmark(spark, sf_dir), "date").select(F.col("security_id").alias("fund"), "date", F.col("close").alias("nav"), "benchmark")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select([r6(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(
    "mf_rolling_windows",
    f"""WITH {BARS}, o AS (SELECT security_id AS fund, date, close, benchmark, last_value(date) OVER w AS d0, last_value(close) OVER w AS c0, last_value(benchmark) OVER w AS b0 FROM bars JOIN bench USING (date)
      WINDOW w AS (PARTITION BY security_id ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1095 DAY PRECEDING)),
    r AS (SELECT fund, exp(ln(close / c0) * 365.0::DOUBLE / (date - d0)) - 1 AS r, exp(ln(close / c0) * 365.0::DOUBLE / (date - d0)) - exp(ln(benchmark / b0) * 365.0::DOUBLE / (date - d0)) AS d FROM o WHERE d0 IS NOT NULL)
    SELECT fund, count(*) AS windows, round_even(CASE WHEN count(*) >= 2 THEN 100 * median(r) END, 6) AS median_pct, round_even(CASE WHEN count(*) >= 2 THEN 100 * min(r) END, 6) AS least_pct, round_even(CASE WHEN count(*) >= 2 THEN 100 * max(r) END, 6) AS most_pct,
      round_even(CASE WHEN count(*) >= 2 THEN 100.0::DOUBLE * count(*) FILTER (d > 0) / count(*) END, 6) AS beat_pct, round_even(CASE WHEN count(*) >= 2 THEN 100 * median(d) END, 6) AS median_excess_pct FROM r GROUP BY 1""",
)
def mf_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(funds.rolling_returns(_levels(spark, sf_dir), 1095))


@query(
    "mf_daily_risk",
    f"""WITH {BARS}, m AS (SELECT security_id AS fund, close / lag(close) OVER w - 1 AS f, benchmark / lag(benchmark) OVER w - 1 AS b FROM bars JOIN bench USING (date) WINDOW w AS (PARTITION BY security_id ORDER BY date)),
    a AS (SELECT fund, count(*) AS n, stddev_samp(f) AS sd, avg(f) AS mean, sqrt(avg(pow(least(f - 0.04::DOUBLE / 252, 0.0), 2))) AS short, avg(f) FILTER (b < 0) AS fd, avg(b) FILTER (b < 0) AS bd FROM m WHERE f IS NOT NULL GROUP BY 1)
    SELECT fund, n, round_even(100 * sd * sqrt(252.0), 6) AS std_pct, round_even(100 * fd / bd, 6) AS downside_capture_pct, round_even(CASE WHEN n >= 2 AND short > 0 THEN (mean * 252 - 0.04::DOUBLE) / (short * sqrt(252.0)) END, 6) AS sortino FROM a""",
)
def mf_daily_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(funds.daily_risk(_levels(spark, sf_dir), 4.0))


_SCHEMES = """schemes AS (SELECT p_partkey AS fund, p_brand AS amc, p_type || ' Fund ' || p_size || CASE p_partkey % 4 WHEN 0 THEN ' - Direct Plan - Growth' WHEN 1 THEN ' (Regular) Growth Option' WHEN 2 THEN ' Regular IDCW Payout' ELSE ' Dir Dividend' END AS name FROM part),
  w AS (SELECT fund, lower(amc) AS amc, regexp_extract_all(lower(name), '[a-z0-9]+') AS words FROM schemes),
  k AS (SELECT fund, amc, CASE WHEN list_has_any(words, ['direct', 'dir']) THEN 'direct' WHEN list_contains(words, 'regular') THEN 'regular' END AS plan,
    CASE WHEN list_has_any(words, ['idcw', 'dividend', 'div', 'payout', 'reinvestment', 'reinvest']) THEN 'idcw' WHEN list_contains(words, 'growth') THEN 'growth' ELSE 'other' END AS option,
    array_to_string(list_filter(words, lambda x: x NOT IN ('idcw', 'dividend', 'div', 'payout', 'reinvestment', 'reinvest', 'direct', 'dir', 'regular', 'plan', 'growth', 'option', 'of')), ' ') AS plain FROM w)"""


def _schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("p_partkey") % 4
    said = F.when(turn == 0, " - Direct Plan - Growth").when(turn == 1, " (Regular) Growth Option").when(turn == 2, " Regular IDCW Payout").otherwise(" Dir Dividend")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fund"), F.col("p_brand").alias("amc"), F.concat("p_type", F.lit(" Fund "), F.col("p_size").cast("string"), said).alias("name"))


@query("mf_plan_option", f"WITH {_SCHEMES} SELECT fund, plan, option, plain FROM k")
def mf_plan_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _schemes(spark, sf_dir).select("fund", funds.plan(name).alias("plan"), funds.option(name).alias("option"), funds.plain_name(name).alias("plain"))


@query(
    "mf_direct_twin",
    f"""WITH {_SCHEMES}, t AS (SELECT r.fund, list_sort(list(d.fund) FILTER (d.fund IS NOT NULL)) AS c FROM k r LEFT JOIN k d ON d.plan = 'direct' AND d.plain = r.plain AND d.option = r.option AND d.amc = r.amc WHERE r.plan = 'regular' GROUP BY 1)
    SELECT fund, CASE WHEN len(c) = 1 THEN 'found' WHEN len(c) > 1 THEN 'ambiguous' ELSE 'none' END AS status, CASE WHEN len(c) = 1 THEN c[1] END AS twin, coalesce(array_to_string(c, ','), '') AS candidates FROM t""",
)
def mf_direct_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funds.direct_twins(_schemes(spark, sf_dir)).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


_CANDIDATES = """candidates AS (SELECT c_custkey AS fund, c_mktsegment AS category, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'regular' ELSE 'direct' END AS plan, CASE WHEN c_custkey % 7 = 0 THEN 'idcw' ELSE 'growth' END AS option,
  c_custkey % 13 <> 0 AS comparable, c_custkey % 17 = 0 AS owned, c_acctbal AS aum_crore, CASE WHEN c_custkey % 19 <> 0 THEN (c_custkey * 3 % 25) / 10.0::DOUBLE END AS ter_pct, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey * 37 % 101)::DOUBLE END AS beat_pct FROM customer),
  why AS (SELECT *, list_filter([CASE WHEN plan IS NULL THEN 'plan unknown' WHEN plan <> 'direct' THEN 'not a direct plan' END, CASE WHEN option = 'idcw' THEN 'pays out' WHEN NOT comparable THEN 'returns not comparable' END,
    CASE WHEN aum_crore IS NULL THEN 'aum_crore unknown' WHEN aum_crore < 500 THEN 'aum_crore fails' END, CASE WHEN ter_pct IS NULL THEN 'ter_pct unknown' WHEN ter_pct > 2.0 THEN 'ter_pct fails' END, CASE WHEN owned THEN 'already owned' END], lambda x: x IS NOT NULL) AS rejected FROM candidates)"""


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = F.expr("case when c_custkey % 11 = 0 then null when c_custkey % 5 = 0 then 'regular' else 'direct' end")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("fund"), F.col("c_mktsegment").alias("category"), plan.alias("plan"), F.expr("if(c_custkey % 7 = 0, 'idcw', 'growth')").alias("option"), F.expr("c_custkey % 13 <> 0").alias("comparable"), F.expr("c_custkey % 17 = 0").alias("owned"),
        F.col("c_acctbal").alias("aum_crore"), F.expr("case when c_custkey % 19 <> 0 then (c_custkey * 3 % 25) / 10.0D end").alias("ter_pct"), F.expr("case when c_custkey % 6 <> 0 then cast(c_custkey * 37 % 101 as double) end").alias("beat_pct"),
    )
    return funds.rejections(rows, {"aum_crore": (">=", 500.0), "ter_pct": ("<=", 2.0)})


@query("fs_filters", f"WITH {_CANDIDATES} SELECT fund, array_to_string(rejected, '; ') AS rejected FROM why")
def fs_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screened(spark, sf_dir).select("fund", F.array_join("rejected", "; ").alias("rejected"))


@query(
    "fs_screen",
    f"""WITH {_CANDIDATES}, r AS (SELECT category, fund, round_even(2.0::DOUBLE * rank() OVER (PARTITION BY category ORDER BY beat_pct DESC NULLS LAST) + 1.0::DOUBLE * rank() OVER (PARTITION BY category ORDER BY ter_pct NULLS LAST), 4) AS score FROM why WHERE len(rejected) = 0)
    SELECT category, fund, score, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score, fund) AS place FROM r) WHERE place <= 5""",
)
def fs_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each category."""
    return funds.screen(_screened(spark, sf_dir), {"beat_pct": (False, 2.0), "ter_pct": (True, 1.0)}).withColumn("place", F.col("place").cast("long"))


_FACTS = {
    "plan": "CASE WHEN k % 2 = 0 THEN 'regular' ELSE 'direct' END", "twin_status": "CASE WHEN k % 3 = 0 THEN 'found' WHEN k % 5 = 0 THEN 'ambiguous' ELSE 'none' END", "comparable": "k % 12 <> 0", "can_replace": "k % 3 = 0",
    "ter_gap_pct": "CASE WHEN k % 9 <> 0 THEN CAST(k % 6 - 4 AS DOUBLE) / 4 END", "overlap_pct": "CAST(k % 71 AS DOUBLE)", "beat_pct": "CASE WHEN k % 10 <> 0 THEN CAST(40 + k * 7 % 61 AS DOUBLE) END", "median_excess_pct": "CAST(k * 3 % 11 - 1 AS DOUBLE)",
    "downside_capture_pct": "CAST(60 + k * 5 % 45 AS DOUBLE)", "max_drawdown_pct": "CAST(k * 11 % 39 AS DOUBLE)", "tenure_years": "CASE WHEN k % 8 <> 0 THEN CAST(k * 13 % 9 AS DOUBLE) END", "valuation_ratio": "CASE WHEN k % 14 <> 0 THEN CAST(k % 7 AS DOUBLE) / 5 END",
}


def _listed(*parts: tuple[str, str, str]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {on} THEN '{code}:{metric}' END" for code, metric, on in parts) + "], lambda x: x IS NOT NULL))"


_FORCING = [
    ("DIRECT_TWIN_AMBIGUOUS", "direct_twin", "plan = 'regular' AND twin_status = 'ambiguous'"), ("NOT_COMPARABLE", "comparable", "NOT comparable"),
    *[("METRIC_UNAVAILABLE", m, f"comparable AND {m} IS NULL") for m in ("beat_pct", "median_excess_pct", "downside_capture_pct", "max_drawdown_pct")],
    ("METRIC_UNAVAILABLE", "ter_gap_pct", "plan = 'regular' AND twin_status = 'found' AND ter_gap_pct IS NULL"), ("MANAGER_TENURE_SHORT", "tenure_years", "tenure_years < 2"), ("VALUATION_STRETCH", "valuation_ratio", "valuation_ratio > 1.25"),
]
_WITHIN = ["beat_pct", "median_excess_pct", "downside_capture_pct", "max_drawdown_pct", "overlap_pct", "tenure_years", "valuation_ratio"]


@query(
    "fd_diagnose",
    f"""WITH k AS (SELECT c_custkey AS k FROM customer), facts AS (SELECT k AS fund, {', '.join(f'{e} AS {c}' for c, e in _FACTS.items())} FROM k),
    l AS (SELECT *, {_listed(('TER_GAP_WITH_DIRECT_TWIN', 'ter_gap_pct', "plan = 'regular' AND twin_status = 'found' AND ter_gap_pct > 0"))} AS r1, {_listed(('OVERLAP_ABOVE_LIMIT', 'overlap_pct', 'overlap_pct > 60'))} AS r2,
      {_listed(('BEAT_PCT_BELOW_MIN', 'beat_pct', 'beat_pct < 50'), ('MEDIAN_EXCESS_BELOW_MIN', 'median_excess_pct', 'median_excess_pct < 0'), ('DOWNSIDE_CAPTURE_ABOVE_MAX', 'downside_capture_pct', 'downside_capture_pct > 100'), ('DRAWDOWN_ABOVE_MAX', 'max_drawdown_pct', 'max_drawdown_pct > 35'))} AS r3,
      {_listed(*_FORCING)} AS forcing, {_listed(*_FORCING, ('METRIC_UNAVAILABLE', 'tenure_years', 'tenure_years IS NULL'), ('METRIC_UNAVAILABLE', 'valuation_ratio', 'valuation_ratio IS NULL'))} AS r4,
      {_listed(*[('WITHIN_LIMITS', m, f'{m} IS NOT NULL') for m in _WITHIN])} AS inside FROM facts),
    d AS (SELECT *, CASE WHEN len(r1) > 0 THEN 'SWITCH_TO_DIRECT' WHEN len(r2) > 0 THEN 'CONSOLIDATE' WHEN len(r3) > 0 THEN CASE WHEN can_replace THEN 'REPLACE' ELSE 'REVIEW' END WHEN len(forcing) > 0 THEN 'REVIEW' ELSE 'KEEP' END AS action FROM l)
    SELECT fund, action, array_to_string(CASE WHEN action = 'KEEP' THEN inside || r4 ELSE r1 || r2 || r3 || r4 END, ' ') AS reasons FROM d""",
)
def fd_diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).selectExpr("k as fund", *[f"{e} as {c}" for c, e in _FACTS.items()])
    told = F.transform("reasons", lambda r: F.concat(r["code"], F.lit(":"), r["metric"]))
    return funds.diagnose(facts).select("fund", "action", F.array_join(told, " ").alias("reasons"))
