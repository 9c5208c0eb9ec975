"""What metrics need, what is computed for them, and their values on odd books."""

from datetime import date

import pytest

from ledgerloom.operators import registry
from ledgerloom.operators.screening import Rule

STATEMENTS = "security_id int, item string, period_type string, period_end date, value double, filed_at date"


def filed(security, item, values, first=2015):
    return [(security, item, "A", date(first + k, 12, 31), v, date(first + k + 1, 3, 1)) for k, v in enumerate(values)]


@pytest.fixture
def stored(spark):
    rows = filed(1, "revenue", [100.0, 110.0, 121.0, 133.1]) + filed(1, "net_income", [10.0, 11.0, 12.0, 20.0]) + filed(1, "total_equity", [40.0, 50.0, 60.0, 100.0]) + filed(1, "total_debt", [None, 0.0, 0.0, 50.0])
    rows += filed(2, "revenue", [100.0, -1.0]) + filed(2, "total_equity", [5.0, 5.0]) + filed(2, "net_income", [0.0, 1.0]) + filed(2, "eps", [-1.0, 1.0, 1.0, 2.0], 2012)
    # a year is missing from these, and a later filing is too late
    rows += [r for r in filed(3, "revenue", [1.0, 2.0, 3.0, 4.0, 5.0]) if r[3].year != 2017] + [(3, "revenue", "A", date(2019, 12, 31), 99.0, date(2030, 1, 1))]
    rows += [(4, "eps", "Q", date(2019, 3, 31), 1.0, date(2019, 5, 1))]
    securities = spark.createDataFrame([(i, "US", "general") for i in (1, 2, 3, 4, 5)], "security_id int, market string, sector_kind string")
    return {"statements": spark.createDataFrame(rows, STATEMENTS), "securities": securities}


def test_values_and_reasons(spark, stored):
    names = ["roe", "revenue_cagr", "eps_cagr", "debt_equity", "net_margin_pct", "roce", "rs_percentile", "hard_flag_count"]
    got = {r["security_id"]: r for r in registry.metric_values(stored["securities"], stored, names, "2020-06-30").collect()}
    assert len(got) == 5
    one, two, three, four, five = (got[i] for i in (1, 2, 3, 4, 5))
    assert (one["roe"], one["debt_equity"], round(one["revenue_cagr"], 6), round(one["net_margin_pct"], 6)) == (25.0, 0.5, 10.0, round(2000 / 133.1, 6))
    assert one["roce"] is None and "operating_income" in one["why_roce"]
    assert (two["roe"], two["why_revenue_cagr"], two["why_eps_cagr"]) == (20.0, "need 4 annual points", "start and end must be positive")
    assert three["why_revenue_cagr"] == "not consecutive fiscal years" and three["why_roe"] == "no net_income or total_equity"
    assert four["why_roe"] == "no fundamentals rows" and five["why_roe"] == "no fundamentals rows"
    assert all(r["why_rs_percentile"] == "bars, benchmark not loaded" and r["why_hard_flag_count"] == "flags not loaded" for r in got.values())


def test_only_what_is_needed(spark, stored):
    assert registry.inputs_needed(["roe", "rs_percentile"]) == {"statements", "bars", "benchmark"}
    assert registry.bundles_needed(["pe", "market_cap", "roe"]) == {"valuation", "fundamentals"}
    with pytest.raises(ValueError, match="unknown metrics: roi"):
        registry.metric_values(stored["securities"], stored, ["roi"], "2020-06-30")
    read = []

    class Watched(dict):
        def __getitem__(self, key):
            read.append(key)
            return super().__getitem__(key)

    registry.metric_values(stored["securities"], Watched(stored), ["roe"], "2020-06-30")
    assert set(read) == {"statements"}
    plan = registry.metric_values(stored["securities"], stored, ["roe"], "2020-06-30")._jdf.queryExecution().optimizedPlan().toString()
    assert "depreciation_amortization" not in plan.split("Project")[1]


def test_flags_and_presets(spark, stored):
    flags = spark.createDataFrame([(1, "hard", "clear"), (1, "soft", "fired"), (2, "hard", "fired")], "security_id int, severity string, state string")
    estimates = spark.createDataFrame([(1, "FY20", date(2020, 5, 1), 2.0), (1, "FY20", date(2020, 6, 1), 3.0)], "security_id int, period string, as_of date, value double")
    rows = {r["security_id"]: r for r in registry.run_screen(stored["securities"], stored | {"flags": flags, "estimates": estimates}, registry.PRESETS["lt-quality-growth"], "2020-06-30").collect()}
    assert rows[1]["matched"] and rows[1]["revisions"] == 50.0 and rows[1]["partial"]
    assert [rows[i]["failed"] for i in (2, 3, 5)] == ["no_hard_red_flag", "quality_roe", "quality_roe"]
    known = registry.registry()
    assert all(isinstance(r, Rule) and r.metric in known for rules in registry.PRESETS.values() for r in rules)


def test_no_securities(spark, stored):
    assert registry.metric_values(stored["securities"].limit(0), stored, ["roe"], "2020-06-30").count() == 0
