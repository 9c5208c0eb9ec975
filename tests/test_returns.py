"""Known answers for dated lots, rates, series checks and fund changes."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import checks, portfolio, returns

DAY = date(2024, 1, 1)


def day():
    return F.lit("2024-01-01").cast("date")


@pytest.fixture
def lots(spark):
    rows = [("exact", date(2023, 1, 1), 10.0, 100.0), ("partial", date(2023, 1, 1), 5.0, 100.0), ("over", date(2023, 1, 1), 7.0, 1.0), ("unpriced", date(2023, 1, 1), 1.0, 1.0), ("old", date(2023, 1, 1), 1.0, 1.0)]
    return spark.createDataFrame(rows, "key string, acquired date, quantity double, cost double")


@pytest.fixture
def held(spark):
    rows = [("exact", 10.0, 110.0, DAY), ("partial", 6.0, 120.0, date(2023, 12, 22)), ("over", 6.0, 5.0, DAY), ("unpriced", 1.0, None, None), ("old", 1.0, 9.0, date(2023, 12, 21)), ("undated", 3.0, 9.0, DAY)]
    return spark.createDataFrame(rows, "key string, held double, price double, price_date date")


def test_lot_report(lots, held):
    found = {r["key"]: (r["state"], r["rate"] and round(r["rate"], 6), r["reason"]) for r in returns.lot_report(lots, held, day()).collect()}
    assert found == {
        "exact": ("exact", 0.1, None), "partial": ("partial", 0.2, None), "over": ("over", None, "lots exceed the holding"), "unpriced": ("exact", None, "no recent price"),
        "old": ("exact", None, "no recent price"), "undated": ("none", None, "no lot dates"),
    }


def test_lots_without_a_holding_are_over(spark, lots, held):
    assert returns.lot_states(lots, held.where("key <> 'exact'"), day()).where("key = 'exact'").first()["state"] == "over"


def test_lines_and_empty_tables(lots, held):
    assert {(r["holding_days"], r["long_term"]) for r in returns.lot_lines(lots, day(), 365).collect()} == {(365, True)}
    assert {r["long_term"] for r in returns.lot_lines(lots, day(), None).collect()} == {None}
    assert returns.lot_report(lots.limit(0), held.limit(0), day()).collect() == []


def test_flows_at_the_rates_of_their_days(spark, lots, held):
    rates = spark.createDataFrame([(date(2022, 12, 26), 80.0), (date(2022, 12, 27), -1.0), (date(2023, 12, 5), 83.0)], "date date, rate double")
    flows = returns.lot_flows(lots, held, day())
    found = {(r["key"], r["date"]): r["amount"] for r in returns.home_flows(flows, rates, day()).collect()}
    # the lot's rate is 6 days old, the valuation's 27; a rate that isn't positive doesn't count
    assert found == {("exact", date(2023, 1, 1)): -80_000, ("exact", DAY): 1100 * 83, ("partial", date(2023, 1, 1)): -40_000, ("partial", DAY): 600 * 83}
    late = spark.createDataFrame([(date(2022, 12, 24), 80.0), (date(2023, 12, 5), 83.0)], "date date, rate double")
    assert returns.home_flows(flows, late, day()).count() == 0


def test_converted_amounts(spark):
    rates = spark.createDataFrame([(date(2024, 1, 1), 80.0), (date(2024, 3, 1), 81.0)], "date date, rate double")
    rows = [(1, "USD", 2.0, date(2024, 1, 11)), (2, "USD", 2.0, date(2024, 1, 12)), (3, "USD", 2.0, date(2024, 1, 31)), (4, "USD", 2.0, date(2024, 2, 1)), (5, "INR", 2.0, date(2023, 1, 1)), (6, "USD", 2.0, date(2024, 3, 31))]
    found = {r["id"]: (r["value_home"], r["stale"]) for r in returns.convert(spark.createDataFrame(rows, "id int, currency string, value double, on date"), rates, "on").collect()}
    assert found == {1: (160, False), 2: (160, True), 3: (160, True), 4: (None, False), 5: (2, False), 6: (162, True)}


def test_pooled_return_of_exact_lots(spark, lots, held):
    flows = returns.lot_flows(lots, held, day()).withColumn("portfolio", F.lit(1))
    values = spark.createDataFrame([(1, "exact", 30.0, "exact"), (1, "partial", 70.0, "partial"), (2, "x", 5.0, "none")], "portfolio int, key string, value double, state string")
    found = {r["portfolio"]: r for r in returns.pooled_return(flows, values).collect()}
    assert (round(found[1]["rate"], 6), found[1]["coverage_pct"], found[1]["reason"]) == (0.1, 30, None)
    assert (found[2]["rate"], found[2]["coverage_pct"], found[2]["reason"]) == (None, 0, "no holding has exact lots")


def test_flows_without_a_return(spark):
    rows = [("one", DAY, 5.0), ("day", DAY, -5.0), ("day", DAY, 5.0), ("sign", DAY, 5.0), ("sign", date(2024, 2, 1), 5.0), ("zero", DAY, 0.0)]
    found = portfolio.xirr(spark.createDataFrame(rows, "key string, date date, amount double"), "key")
    assert {r["key"]: (r["rate"], r["reason"]) for r in found.collect()} == {"one": (None, "flows have one sign"), "day": (None, "flows fall on one day"), "sign": (None, "flows have one sign")}


def test_taxes(spark):
    lots = spark.createDataFrame([("a", 400, 100.0), ("a", 400, -50.0), ("b", 10, 100.0), ("c", 400, None), ("c", 400, 1.0)], "key string, holding_days int, gain double")
    assert {tuple(r) for r in returns.tax_impact(lots, 365, None, 10.0).collect()} == {("a", 50.0, 10.0, None), ("b", 100.0, None, "short-term rate not set"), ("c", None, None, "gain unknown")}
    assert {r["reason"] for r in returns.tax_impact(lots, None, 1.0, 1.0).where("key = 'a'").collect()} == {"long-term threshold not set"}


def test_trailing_year(spark):
    points = spark.createDataFrame([("a", date(2023, 1, 1), 100.0), ("a", date(2023, 1, 2), 50.0), ("a", DAY, 110.0), ("b", DAY, 1.0)], "k string, date date, v double")
    assert {tuple(r) for r in returns.trailing_year(points, "k", "v").collect()} == {("a", 10.0), ("b", None)}


def test_field_faults(spark):
    texts = {"1,234.50": None, " 7 ": None, "": "missing", None: "missing", "nan": "not a number", "Infinity": "not a number", "1.2.3": "not a number"}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", checks.decimal_fault(F.col("t")).alias("f"))
    assert {r["t"]: r["f"] for r in found.collect()} == texts
    assert checks.missing_columns(found, ["f", "close", "t"]) == ["close"]


def test_series_and_sources(spark):
    points = spark.createDataFrame([("a", DAY, "x", 100.0), ("a", DAY, "y", 90.0), ("a", date(2024, 1, 2), "x", 0.0), ("b", DAY, "y", 1.0)], "k string, date date, source string, value double")
    assert [tuple(r) for r in checks.series_faults(points.where("source = 'x'"), "k", "value").collect()] == [("a", date(2024, 1, 2), "not positive")]
    assert {r["reason"] for r in checks.series_faults(points, "k", "value").collect()} == {"not positive", "repeated date"}
    assert checks.disagreements(points, "k", "x", "y", 0.05).count() == 1 and checks.disagreements(points, "k", "x", "y", 0.1).count() == 0


def test_gaps(spark):
    points = spark.createDataFrame([("a", date(2024, 1, 5)), ("a", date(2024, 1, 10))], "k string, date date")
    sessions = spark.createDataFrame([(date(2024, 1, d),) for d in (4, 5, 8, 9, 10, 11)], "date date")
    assert {r["date"].day for r in checks.missing_sessions(points, sessions, "k").collect()} == {8, 9}
    assert [tuple(r) for r in checks.trailing_gap(points, "k", F.lit("2024-01-16").cast("date"), 3).collect()] == [("a", date(2024, 1, 11), date(2024, 1, 16), 4)]
    assert checks.trailing_gap(points, "k", F.lit("2024-01-16").cast("date"), 4).count() == 0


def test_chunks(spark):
    text = spark.createDataFrame([("abcdefg",)], "t string")
    for cursor, part, after in ((0, "abc", 3), (3, "def", 6), (6, "g", None), (9, "", None)):
        a, b = checks.chunk(F.col("t"), cursor, 3)
        assert tuple(text.select(a, b).first()) == (part, after)


def test_fund_changes(spark):
    rows = [
        ("f", date(2024, 1, 1), "ann", "equity", 1.0, "1", "Emerging Fund", "amfi"), ("f", date(2024, 1, 2), None, "equity", 1.25, "1", "Emerging Fund", "amfi"),
        ("f", date(2024, 1, 3), "bob", "debt", 1.6, "1", "Fund (merged)", "amfi"), ("f", date(2024, 1, 4), "bob", "debt", None, "2", "Fund", "amfi"),
    ]
    versions = spark.createDataFrame(rows, "fund string, as_of date, manager string, category string, ter double, code string, name string, source string")
    found = {(r["as_of"].day, r["change"]) for r in checks.fund_changes(versions, "fund", 0.25).collect()}
    assert found == {(3, "manager"), (3, "category"), (3, "ter"), (3, "merger"), (4, "merger")}
