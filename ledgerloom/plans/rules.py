"""Queries over rules that decide: composite scores, committee ceilings, calibration. Orders and customers stand for cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.stats import r6
from ledgerloom.operators import calibration, committee, composite
from ledgerloom.plans.registry import query, table

_INPUTS = [composite.Input("q1", "quality"), composite.Input("q2", "quality"), composite.Input("v1", "value"), composite.Input("g1", "growth"), composite.Input("m1", "momentum", True), composite.Input("m2", "momentum", True), composite.Input("r1", "risk", True), composite.Input("health", "risk")]
_RAW = {"q1": (37, 5), "q2": (43, 4), "v1": (53, 6), "g1": (71, 3), "m1": (29, 9), "m2": (83, 2), "r1": (41, 8), "pct": (17, 10)}


def _raw_sql() -> str:
    return ", ".join(f"CASE WHEN c_custkey % {n} <> 0 THEN CAST(c_custkey * {k} % 101 AS DOUBLE) END AS {c}" for c, (k, n) in _RAW.items())


@query(
    "sc_score_universe",
    f"""WITH r AS (SELECT c_custkey AS security_id, {_raw_sql()}, CASE WHEN c_custkey % 7 <> 0 THEN greatest(0.0, 100.0 - 50.0 * (c_custkey % 33 = 0)::INT - 20.0 * (c_custkey % 3))::DOUBLE END AS health, c_custkey % 33 = 0 AND c_custkey % 7 <> 0 AS hard FROM customer),
    p AS (SELECT *, list_avg([q1, q2]) AS quality, v1 AS value, g1 AS growth FROM r), s AS (SELECT *, list_avg([quality, value, growth]) AS support FROM p),
    h AS (SELECT *, CASE WHEN list_avg([m1, m2]) IS NOT NULL THEN least(list_avg([m1, m2]), coalesce(support, 0)) END AS credit, CASE WHEN r1 IS NOT NULL THEN least(r1, coalesce(support, 0)) END AS held FROM s),
    f AS (SELECT *, CASE WHEN pct > 90 THEN greatest(0.0, credit - 25) ELSE credit END AS momentum, list_avg([held, health]) AS risk, len(list_filter([q1, q2, v1, g1, m1, m2, r1, health], lambda x: x IS NOT NULL)) AS available FROM h),
    g AS (SELECT *, CASE WHEN quality IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN value IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN growth IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN credit IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN risk IS NOT NULL THEN 10 ELSE 0 END AS w FROM f),
    c AS (SELECT *, CASE WHEN w > 0 AND available * 100 >= 70 * 8 THEN (coalesce(30 * quality, 0) + coalesce(25 * value, 0) + coalesce(25 * growth, 0) + coalesce(10 * CASE WHEN credit IS NOT NULL THEN momentum END, 0) + coalesce(10 * risk, 0)) / w END AS composite FROM g),
    b AS (SELECT *, CASE WHEN composite IS NULL THEN 'insufficient_data' WHEN composite >= 75 AND coalesce(support >= 50, false) THEN 'top' WHEN composite >= 60 THEN 'upper' WHEN composite >= 40 THEN 'hold' ELSE 'weak' END AS band0 FROM c)
    SELECT security_id, round_even(quality, 6) AS quality, round_even(CASE WHEN credit IS NOT NULL THEN momentum END, 6) AS momentum, round_even(risk, 6) AS risk, round_even(support, 6) AS support, round_even(composite, 6) AS composite,
      CASE WHEN hard AND band0 IN ('top', 'upper') THEN 'hold' ELSE band0 END AS band FROM b""",
)
def sc_score_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(key.alias("security_id"), *[F.when(key % n != 0, (key * k % 101).cast("double")).alias(c) for c, (k, n) in _RAW.items()], (key % 33 == 0).cast("int").alias("hard"), (key % 3).alias("soft"), (key % 7).alias("tested"))
    rows = raw.withColumn("health", composite.flag_health(F.col("hard"), F.col("soft"), F.col("tested")))
    found = composite.score(rows, _INPUTS, composite.LONG_TERM, F.col("pct"), (F.col("hard") > 0) & (F.col("tested") > 0))
    return found.select("security_id", *[r6(F.col(c)).alias(c) for c in ("quality", "momentum", "risk", "support", "composite")], "band")


_CASES = {
    "proposed": "CASE o_orderkey % 7 WHEN 0 THEN 'BUY' WHEN 1 THEN 'ACCUMULATE' WHEN 2 THEN 'HOLD' WHEN 3 THEN 'TRIM' WHEN 4 THEN 'SELL' WHEN 5 THEN 'AVOID' ELSE 'INSUFFICIENT_DATA' END",
    "excluded": "o_orderkey % 19 = 0", "hard": "o_orderkey % 23 = 0", "over": "o_totalprice > 200000", "sector_over": "CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 29 = 0 END", "days": "o_totalprice / 30000",
    "headroom": "CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 8 - 1 AS DOUBLE) END", "proposal": "CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey % 9 AS DOUBLE) END", "inputs": "o_orderkey % 20", "views": "o_custkey % 5",
    "band": "CASE WHEN o_orderkey % 15 = 0 THEN 'insufficient_data' ELSE 'upper' END", "capped": "o_orderkey % 21 = 0",
}


@query(
    "cr_committee",
    f"""WITH c AS (SELECT o_orderkey AS call_id, {', '.join(f'{e} AS {n}' for n, e in _CASES.items())} FROM orders),
    v AS (SELECT *, list_filter([CASE WHEN excluded THEN 'excluded_by_profile' END, CASE WHEN hard THEN 'hard_red_flag' END, CASE WHEN "over" THEN 'position_over_limit' END, CASE WHEN sector_over THEN 'sector_over_limit' END, CASE WHEN days > 8 THEN 'days_to_trade_over_limit' END], lambda x: x IS NOT NULL) AS why,
      greatest(0.0, least(5.0, headroom, proposal)) AS cap, least(100.0::DOUBLE * inputs / 19, 100.0::DOUBLE * views / 4) AS coverage FROM c),
    d AS (SELECT *, CASE WHEN band = 'insufficient_data' OR coverage < 50 THEN 'INSUFFICIENT_DATA' WHEN proposed IN ('BUY', 'ACCUMULATE') AND (len(why) > 0 OR capped OR hard) THEN 'HOLD' ELSE proposed END AS verdict FROM v)
    SELECT call_id, array_to_string(why, ' ') AS veto, round_even(coverage, 6) AS coverage, verdict, round_even(CASE WHEN NOT (verdict IN ('SELL', 'AVOID', 'INSUFFICIENT_DATA') OR (verdict = 'HOLD' AND proposed <> 'HOLD' AND len(why) > 0) OR proposal IS NULL) THEN least(proposal, cap) END, 6) AS weight FROM d""",
)
def cr_committee(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    cases = table(spark, sf_dir, "orders").selectExpr("o_orderkey as call_id", *[f"{e} as `{n}`" for n, e in _CASES.items()])
    why = committee.veto_reasons(c("excluded"), c("hard"), c("over"), c("sector_over"), c("days"), 8.0)
    judged = cases.withColumns({"why": why, "cap": committee.weight_cap(F.lit(5.0), c("headroom"), c("proposal")), "coverage": committee.coverage_pct(c("inputs"), F.lit(19), c("views"), F.lit(4))})
    vetoed = F.size("why") > 0
    ruled = judged.withColumn("verdict", committee.verdict_ceiling(c("proposed"), vetoed, c("band"), c("capped"), c("hard"), c("coverage"), 50.0))
    weight = committee.final_weight(c("verdict"), c("proposal"), c("cap"), vetoed & (c("proposed") != "HOLD"))
    return ruled.select("call_id", F.array_join("why", " ").alias("veto"), r6(c("coverage")).alias("coverage"), "verdict", r6(weight).alias("weight"))


def _convictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.expr("case substring(o_orderpriority, 1, 1) when '1' then 'high' when '3' then 'medium' when '5' then 'low' end")
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(level.alias("conviction"), F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderkey") % 4 != 0, (price > 150000).cast("double")).alias("hit"), ((price - 150000) / 10000).alias("call_excess"))


@query("cal_bootstrap")
def cal_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.buckets(_convictions(spark, sf_dir))


@query("cal_calibrate")
def cal_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.verdict(calibration.buckets(_convictions(spark, sf_dir)))
