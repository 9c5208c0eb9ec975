"""Known answers."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.stats import mid_rank
from ledgerloom.operators import indicators, ledger, pit, portfolio, schedule, screening, text


def one(spark, values, column):
    return spark.createDataFrame([(values,)], "v array<double>").select(column(F.col("v")).alias("x")).first()["x"]


def test_indicators(spark):
    assert one(spark, [1.0, 2.0, 3.0, 4.0, 5.0], lambda v: indicators.ema(v, 3)) == pytest.approx(4)
    assert one(spark, [10.0, 11.0, 10.0, 12.0, 13.0, 12.0, 14.0], lambda v: indicators.rsi(v, 3)) == pytest.approx(77.5862068965517)
    assert one(spark, [5.0] * 9, lambda v: indicators.rsi(v, 3)) is None
    assert one(spark, [1.0], lambda v: indicators.ema(v, 3)) is None


def test_mid_rank_of_one_is_fifty(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None)], "k string, v double")
    assert {r["k"]: r["r"] for r in df.select("k", mid_rank(F.col("v")).alias("r")).collect()} == {"a": 50.0, "b": None}


def test_later_filing_never_changes_an_earlier_answer(spark):
    rows = [("x", "s1", date(2020, 1, 1), 1.0), ("x", "s1", date(2020, 3, 1), 2.0), ("x", "s0", date(2020, 6, 1), 3.0)]
    df = spark.createDataFrame(rows, "k string, source string, filed_at date, v double")
    day = F.lit("2020-02-01").cast("date")
    assert [r["v"] for r in pit.latest_as_of(df, ["k"], day).collect()] == [1.0]
    assert [r["v"] for r in pit.statement_source(df, ["k"], "source", ["s0", "s1"], day).collect()] == [1.0]


def test_xirr(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1), -100.0), ("a", date(2020, 12, 31), 110.0), ("b", date(2020, 1, 1), -5.0)], "k string, date date, amount double")
    found = {r["k"]: r for r in portfolio.xirr(df, "k").collect()}
    assert found["a"]["rate"] == pytest.approx(0.1, abs=1e-6)
    assert found["b"]["rate"] is None and found["b"]["reason"] == "flows have one sign"


def test_screen_skips_and_requires(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, None, 1.0), (3, None, None)], "security_id long, a double, b double")
    rules = [screening.Rule("ra", "a", ">", 1), screening.Rule("rb", "b", ">", 0)]
    found = {r["security_id"]: (r["matched"], r["partial"]) for r in screening.screen(df, rules).collect()}
    assert found == {1: (True, True), 2: (True, True), 3: (False, False)}
    strict = [screening.Rule("ra", "a", ">", 1, required=True)]
    assert {r["security_id"]: r["failed"] for r in screening.screen(df, strict).collect()} == {1: None, 2: "ra", 3: "ra"}
    with pytest.raises(ValueError):
        screening.Rule("x", "a", "between", 1)


def test_calendar():
    assert schedule.easter(2024) == date(2024, 3, 31)
    assert date(2021, 12, 24) in schedule.us_holidays(2021)


def test_text(spark):
    df = spark.createDataFrame([("HTTP://A.com/x/?utm_source=q&b=2&a=1#f", "Deal & Co. Ltd")], "u string, n string")
    r = df.select(text.canonical_url(F.col("u")).alias("u"), text.company_name(F.col("n"), ["ltd", "co"]).alias("n")).first()
    assert (r["u"], r["n"]) == ("http://a.com/x?a=1&b=2", "deal and")
