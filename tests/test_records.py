"""Known answers for registers and logs."""

from datetime import date

from pyspark.sql import functions as F

from ledgerloom.operators import records


def test_venues(spark):
    wanted = {" nyse   arca ": "ARCA", "AMEX": "NYSE", "Nasdaq": "NASDAQ", "CBOE": None, None: None}
    found = spark.createDataFrame([(k,) for k in wanted], "t string").select("t", records.venue(F.col("t")).alias("v"))
    assert {r["t"]: r["v"] for r in found.collect()} == wanted


def test_scheme_rows(spark):
    rows = [(1, "X Dividend", "7"), (3, "X Growth", "7"), (2, None, "7"), (5, "Y Payout", "8"), (4, "Y Reinvestment", "8"), (6, "Z", None), (9, "Dividends Fund", "9"), (10, "Fund", "9")]
    found = records.scheme_rows(spark.createDataFrame(rows, "security_id int, name string, code string"))
    # "Dividends" is another word
    assert {r["code"]: r["security_id"] for r in found.collect()} == {"7": 2, "8": 4, "9": 9}


def test_resolved_isins(spark):
    securities = spark.createDataFrame([(3, "A", False), (2, " a", False), (1, "A", True), (4, "B", False), (5, None, False)], "security_id int, isin string, unresolved boolean")
    aliases = spark.createDataFrame([(4, "A"), (4, "OLD"), (1, "GONE")], "security_id int, isin string")
    asked = spark.createDataFrame([("a",), ("old ",), ("GONE",), (None,)], "isin string")
    assert {r["isin"]: r["security_id"] for r in records.resolve_isins(asked, securities, aliases).collect()} == {"a": 2, "old ": 4, "GONE": None, None: None}


def test_theses_and_zones(spark):
    stored = spark.createDataFrame([(1, 10, "active"), (2, 20, "closed")], "thesis_id int, security_id int, status string")
    fresh = spark.createDataFrame([(3, 10, "active"), (4, 20, "active"), (5, 20, "active"), (6, 10, "closed")], "thesis_id int, security_id int, status string")
    assert {r["thesis_id"] for r in records.refused_theses(stored, fresh).collect()} == {3, 5}
    rows = [(1.0, 2.0, None), (2.0, 2.0, None), (None, None, None), (1.0, None, "one end missing"), (0.0, 1.0, "not positive"), (3.0, 2.0, "ends reversed")]
    found = spark.createDataFrame(rows, "a double, b double, w string").select("w", records.zone_fault(F.col("a"), F.col("b")).alias("f"))
    assert all(r["w"] == r["f"] for r in found.collect())


def test_month_windows(spark):
    cases = {date(2024, 3, 14): (date(2024, 2, 15), date(2024, 3, 15)), date(2024, 3, 15): (date(2024, 3, 15), date(2024, 4, 15)), date(2024, 1, 1): (date(2023, 12, 15), date(2024, 1, 15))}
    found = spark.createDataFrame([(d,) for d in cases], "d date").select("d", *records.month_window(F.col("d"), 15))
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == cases
    assert tuple(spark.range(1).select(*records.month_window(F.lit("2024-01-31").cast("date"), 28)).first()) == (date(2024, 1, 28), date(2024, 2, 28))


def test_quota(spark):
    day = date(2024, 1, 20)
    calls = spark.createDataFrame([("v", day, 7, "auto"), ("v", day, 1, "manual"), ("v", date(2024, 1, 14), 50, "auto"), ("w", day, 1, "auto")], "vendor string, day date, calls int, kind string")
    limits = spark.createDataFrame([("v", 1, 100, 500), ("v", 2, 10, None)], "vendor string, id int, daily int, monthly int")
    found = {r["vendor"]: tuple(r)[1:] for r in records.quota_state(calls, limits, F.lit("2024-01-20").cast("date"), 15).collect()}
    assert found == {"v": (8, 8, 1, 10, 500, True), "w": (1, 1, 0, None, None, False)}


def test_logs(spark):
    runs = spark.createDataFrame([("a", date(2024, 1, 1), "x"), ("a", date(2024, 1, 2), "y"), ("b", date(2023, 1, 1), "z")], "job string, trading_date date, state string")
    assert {r["state"] for r in records.last_runs(runs).collect()} == {"y", "z"}
    levels = spark.createDataFrame([(1, 1, 9.0), (2, 1, 8.0), (3, 2, 7.0)], "id int, security_id int, level double")
    assert {tuple(r) for r in records.latest_levels(levels).collect()} == {(1, 8.0), (2, 7.0)}
    held = spark.createDataFrame([("f", 1, "b", 5.0), ("f", 1, "a", 5.0), ("f", 1, "c", 6.0), ("f", 2, "a", 9.0)], "fund string, month int, isin string, weight double")
    assert [r["isin"] for r in records.month_holdings(held, F.lit(1)).orderBy("turn").collect()] == ["c", "a", "b"]
