"""Known answers for trailing earnings, cash flow, ranges, revisions, owners, ideas, savings, lots and fund analysis."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import valuation as v


def known(spark, rows):
    made = spark.createDataFrame([(*r, date(2023, 1, 1)) for r in rows], "security_id int, item string, period_type string, period_end date, value double, filed_at date")
    return v.known_figures(made, F.lit("2024-01-01").cast("date"))


ENDS = [date(2022, 3, 31), date(2022, 6, 30), date(2022, 9, 30), date(2022, 12, 31)]


def test_trailing_earnings(spark):
    rows = [(1, "eps", "Q", e, float(k)) for k, e in enumerate(ENDS)] + [(1, "eps", "A", ENDS[3], 9.0), (1, "shares", "Q", ENDS[0], 5.0), (1, "shares", "A", date(2021, 12, 31), 4.0)]
    rows += [(2, "eps", "Q", e, 1.0) for e in [date(2021, 3, 31), *ENDS[1:]]] + [(2, "eps", "A", ENDS[3], 9.0), (3, "eps", "Q", ENDS[0], 1.0)]
    found = {r["security_id"]: (r["eps"], r["eps_basis"], r["shares"]) for r in v.facts(known(spark, rows), ("shares",), ()).collect()}
    # of security 2 a quarter is missing, so the last four span too long
    assert found == {1: (6.0, "ttm", 5.0), 2: (9.0, "last_annual", None), 3: (None, None, None)}


def test_what_is_not_yet_known(spark):
    made = spark.createDataFrame([(1, "eps", "A", date(2022, 12, 31), 1.0, date(2024, 1, 2)), (1, "eps", "A", date(2024, 12, 31), 2.0, date(2023, 1, 1))], "security_id int, item string, period_type string, period_end date, value double, filed_at date")
    assert v.known_figures(made, F.lit("2024-01-01").cast("date")).count() == 0


def test_free_cash_flow(spark):
    rows = [(1, "cfo", "A", ENDS[3], 10.0), (1, "capex", "A", ENDS[3], -4.0), (1, "cfo", "A", date(2023, 12, 31), 99.0), (2, "cfo", "A", ENDS[3], 1.0)]
    assert [tuple(r) for r in v.free_cash_flow(known(spark, rows)).collect()] == [(1, ENDS[3], 6.0)]


def test_range(spark):
    rows = spark.createDataFrame([(1, 100.0, 10.0), (2, None, 10.0), (3, 0.0, 10.0), (4, 100.0, None), (5, 1e-9, 10.0)], "k int, cash double, shares double")
    flat = v.fair_range(F.col("cash"), F.col("shares"), F.lit(100.0), {"base": (0.0, 0.1, 0.0)}, 10)
    found = {r["k"]: r for r in rows.select("k", *[c.alias(n) for n, c in flat.items()]).collect()}
    # without growth a flow of 100 at ten percent is worth 1000, which is the market value
    assert found[1]["base_equity"] == pytest.approx(1000) and found[1]["base_per_share"] == pytest.approx(100) and found[1]["implied_growth_pct"] == pytest.approx(0, abs=1e-6)
    assert [found[k]["reason"] for k in range(1, 6)] == [None, "no cash flow", "cash flow is not positive", None, None]
    assert found[4]["base_per_share"] is None and found[4]["implied_reason"] == "no market value"
    assert found[5]["implied_reason"] == "market value is out of the range of growth"


def test_revisions(spark):
    rows = [(1, "y", date(2024, 1, 1), 1.0), (1, "y", date(2024, 1, 20), 2.0), (1, "y", date(2024, 1, 30), 3.0), (1, "x", date(2024, 1, 25), 9.0), (2, "y", date(2024, 1, 30), 1.0), (3, "y", date(2024, 1, 21), 0.0), (3, "y", date(2024, 1, 22), 1.0), (4, "y", date(2023, 1, 1), 1.0)]
    found = v.revisions(spark.createDataFrame(rows, "security_id int, period string, as_of date, value double"), F.lit("2024-01-31").cast("date"), 14)
    assert {tuple(r) for r in found.collect()} == {(1, 50.0, None), (2, None, "one snapshot"), (3, None, "earlier estimate is zero"), (4, None, "one snapshot")}


def test_owner_change(spark):
    rows = [(1, e, p, 2.0) for e, p in zip([*ENDS, date(2023, 3, 31)], [50.0, 1.0, 1.0, 1.0, 48.5])] + [(2, ENDS[0], 50.0, None)] + [(3, e, None, 1.0) for e in [*ENDS, date(2023, 3, 31)]]
    found = v.owner_change(spark.createDataFrame(rows, "security_id int, period_end date, promoter_pct double, pledged_pct double"))
    assert {tuple(r) for r in found.collect()} == {(1, 2.0, -1.5, None), (2, None, None, "fewer than five quarters"), (3, 1.0, None, "holding not reported")}


def test_ranked_ideas(spark):
    rows = [(1, "a", "BUY", "low", 99.0, False), (2, "b", "BUY", "high", None, False), (3, "c", "ACCUMULATE", "high", 50.0, False), (4, "d", "BUY", "high", 90.0, True), (5, "e", "HOLD", "high", 90.0, False), (6, "f", "BUY", None, 90.0, False)]
    ideas = spark.createDataFrame(rows, "security_id int, symbol string, verdict string, conviction string, composite double, vetoed boolean")
    assert [r["security_id"] for r in v.ranked_ideas(ideas, 9).orderBy("place").collect()] == [3, 2, 1, 6]
    assert v.ranked_ideas(ideas, 2).count() == 2


def test_savings(spark):
    rows = spark.createDataFrame([(1.5, 0.5, 1000.0), (0.5, 0.5, 1000.0), (None, 0.5, None)], "r double, d double, v double")
    found = [tuple(r) for r in rows.select(*[c.alias(n) for n, c in v.saving_of_direct(F.col("r"), F.col("d"), F.col("v")).items()]).collect()]
    assert found == [(1.0, 10.0, None), (0.0, None, "direct is not cheaper"), (None, None, "unknown: regular ratio, value")]


def test_valued_lots(spark):
    lots = spark.createDataFrame([(k, date(2023, 1, 1), 2.0, c) for k, c in (("ok", 3.0), ("costless", None), ("off", 1.0), ("old", 1.0), ("none", 1.0))], "key string, acquired date, units double, unit_cost double")
    day = date(2024, 1, 1)
    funds = spark.createDataFrame([("ok", 2.0005, 10.0, day), ("costless", 2.0, 10.0, day), ("off", 2.01, 10.0, day), ("old", 2.0, 10.0, date(2023, 12, 1)), ("none", 2.0, None, None)], "key string, held double, nav double, nav_date date")
    found = {r["key"]: (r["holding_days"], r["value"], r["gain"], r["reason"]) for r in v.valued_lots(lots, funds, F.lit("2024-01-01").cast("date"), 10).collect()}
    assert found == {"ok": (365, 20.0, 14.0, None), "costless": (365, 20.0, None, None), "off": (365, None, None, "lots differ from the holding"), "old": (365, None, None, "value a unit is old"), "none": (365, None, None, "no value a unit")}


def test_fund_analysis(spark):
    days = [date(2024, 1, d) for d in range(1, 11)]
    rows = [(f, d, 100.0 + (i % 3), 50.0 + (i % 2) if i < n else None) for f, n in (("whole", 10), ("most", 8), ("few", 7), ("none", 0)) for i, d in enumerate(days)]
    found = {r["fund"]: r for r in v.analyse_funds(spark.createDataFrame(rows, "fund string, date date, nav double, benchmark double"), 365, 0.0).collect()}
    assert {f: (r["coverage_pct"], r["reason"]) for f, r in found.items()} == {"whole": (100, None), "most": (80, None), "few": (70, "benchmark covers too few days"), "none": (0, "no benchmark")}
    assert found["few"]["downside_capture_pct"] is None and found["most"]["downside_capture_pct"] is not None
    assert len({round(r["std_pct"], 9) for r in found.values()}) == 1
