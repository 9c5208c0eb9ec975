"""Known answers for call scores, folding, alert hygiene, regime, flat baselines, oversales, closures and redaction."""

import re
import unicodedata
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import fundamentals, indicators, ledger, monitor, portfolio, prices, schedule, text

ISSUE = date(2026, 1, 5)


def score(spark, verdict, closes, levels, today=date(2026, 2, 1), cost=0.25, price_date=None, as_of=ISSUE):
    bars = spark.createDataFrame([(1, d, float(c)) for d, c in closes.items()], "security_id long, date date, close double")
    bench = spark.createDataFrame([(d, float(c)) for d, c in levels.items()], "date date, benchmark double")
    calls = spark.createDataFrame([(1, 1, as_of, verdict, price_date)], "call_id long, security_id long, date date, verdict string, price_date date")
    return ledger.score_calls(calls, bars, bench, 1, today.isoformat(), cost, 7).first()


def week(a, b):
    return {ISSUE: a, ISSUE + timedelta(7): b}


@pytest.mark.parametrize(
    ("verdict", "close", "level", "wanted"),
    [("BUY", 112, 210, (12.0, 5.0, 6.75, True)), ("ACCUMULATE", 105.1, 210, (5.1, 5.0, -0.15, False)), ("SELL", 97, 208, (-3.0, 4.0, 7.0, True)), ("TRIM", 106, 208, (6.0, 4.0, -2.0, False)), ("HOLD", 112, 210, (12.0, 5.0, None, None))],
)
def test_scored_calls(spark, verdict, close, level, wanted):
    r = score(spark, verdict, week(100, close), week(200, level))
    assert r["status"] == "scored" and (r["ret"], r["benchmark"], r["call_excess"], r["hit"]) == wanted


def test_calls_that_cannot_be_scored(spark):
    assert score(spark, "INSUFFICIENT_DATA", week(100, 110), week(200, 210))["status"] == "insufficient"
    # a series that ends before the target: pending until the days of grace are over
    short = {ISSUE: 200, ISSUE + timedelta(6): 210}
    assert score(spark, "BUY", week(100, 110), short, today=date(2026, 1, 18))["status"] == "pending"
    assert score(spark, "BUY", week(100, 110), short, today=date(2026, 1, 19))["status"] == "insufficient"
    # an entry bar of six days before, and one that is the given day's
    old = {ISSUE - timedelta(6): 100, ISSUE + timedelta(7): 110}
    assert score(spark, "BUY", old, week(200, 210))["status"] == "insufficient"
    near = {ISSUE - timedelta(3): 100, ISSUE: 150, ISSUE + timedelta(7): 120}
    levels = {ISSUE - timedelta(4): 200, ISSUE + timedelta(7): 220}
    assert score(spark, "BUY", near, levels, price_date=ISSUE - timedelta(3))["ret"] == 20.0
    assert score(spark, "BUY", near, levels, price_date=ISSUE - timedelta(2))["status"] == "insufficient"
    assert score(spark, "BUY", week(0, 110), week(200, 210))["status"] == "insufficient"
    stale = {ISSUE: 100, ISSUE + timedelta(30): 120}
    assert ledger.score_calls(spark.createDataFrame([(1, 1, ISSUE, "BUY")], "call_id long, security_id long, date date, verdict string"), spark.createDataFrame([(1, d, float(c)) for d, c in stale.items()], "security_id long, date date, close double"), spark.createDataFrame([(d, float(c)) for d, c in stale.items()], "date date, benchmark double"), 3, "2026-03-01", 0.25, 7).first()["status"] == "insufficient"


def test_scorecard_counts_holds_without_hits(spark):
    rows = [(1, "scored", True, 2.0, "BUY"), (2, "scored", None, None, "HOLD"), (3, "pending", None, None, "BUY"), (4, "scored", False, -1.0, "BUY")]
    found = {r["member"]: r for r in ledger.scorecard(spark.createDataFrame(rows, "call_id long, status string, hit boolean, call_excess double, verdict string"), ["verdict"], 2).collect()}
    assert (found["BUY"]["calls"], found["BUY"]["scored"], found["BUY"]["hit_pct"], found["BUY"]["worst"], found["BUY"]["enough"]) == (3, 2, 50.0, -1.0, True)
    assert (found["HOLD"]["scored"], found["HOLD"]["hit_pct"], found["HOLD"]["enough"]) == (1, None, False)


def test_folded_calls(spark):
    day = lambda n: ISSUE + timedelta(n)
    rows = [(1, 7, day(0), "BUY", None), (2, 7, day(0), "BUY", None), (3, 7, day(27), "BUY", None), (4, 7, day(28), "BUY", None), (5, 7, day(1), "SELL", None), (6, 7, day(2), "SELL", 5), (7, 8, day(3), "BUY", None)]
    found = ledger.fold_repeats(spark.createDataFrame(rows, "call_id long, security_id long, date date, verdict string, corrects_id long"), 28)
    assert sorted(r["call_id"] for r in found.collect()) == [2, 4, 6, 7]


def test_hygiene(spark):
    days = spark.createDataFrame([(date(2026, 1, 1) + timedelta(n),) for n in range(60) if (date(2026, 1, 1) + timedelta(n)).weekday() < 5], "date date")
    # 2026-01-05 is a Monday: the fifth session after it is Monday the 12th, the sixth Tuesday the 13th
    history = spark.createDataFrame([("r", 1, ISSUE), ("r", 2, ISSUE)], "rule string, security_id long, date date")
    fired = [(1, "r", 1, date(2026, 1, 12)), (2, "r", 2, date(2026, 1, 13)), (3, "r", 2, date(2026, 1, 13)), (4, "s", 1, date(2026, 1, 13)), (5, "t", 1, date(2026, 1, 13))]
    found = schedule.hygiene(spark.createDataFrame(fired, "alert_id long, rule string, security_id long, date date"), history, days, 5, 4, used=2)
    assert {r["alert_id"]: r["fate"] for r in found.collect()} == {1: "repeat", 2: "sent", 3: "repeat", 4: "sent", 5: "cap"}


def test_regime_needs_the_index(spark):
    day = lambda n: ISSUE + timedelta(n)
    up = lambda key: [(key, day(n), 10.0 + n) for n in range(4)]
    bars = spark.createDataFrame(up("a") + up("b"), "security_id string, date date, close double")
    for levels, wanted in (([1, 2, 3, 4], "risk_on"), ([4, 3, 2, 1], "neutral"), ([1], "unavailable")):
        index = spark.createDataFrame([(day(n), float(v)) for n, v in enumerate(levels)], "date date, close double")
        assert monitor.regime(bars, index, 3, 60.0, 40.0, 2).first()["regime"] == wanted
    falling = spark.createDataFrame([("a", day(n), 10.0 - n) for n in range(4)], "security_id string, date date, close double")
    index = spark.createDataFrame([(day(n), 4.0 - n) for n in range(4)], "date date, close double")
    assert monitor.regime(falling, index, 3, 60.0, 40.0, 1).first()["regime"] == "risk_off"


def test_zeros_and_flat_series(spark):
    bars = spark.createDataFrame([(1, ISSUE + timedelta(n), 10.0 if n < 25 else 20.0) for n in range(26)], "security_id long, date date, close double")
    assert indicators.big_moves(bars).count() == 0
    figures = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (1, "c", 1.0)], "k long, source string, value double")
    found = fundamentals.cross_check(figures, ["k"], "source", "value", ["a", "b", "c"], 25.0)
    assert {r["source"]: r["status"] for r in found.collect()} == {"a": "base", "b": "match", "c": "differs"}
    levels = spark.createDataFrame([(1, ISSUE, 0.0), (1, ISSUE + timedelta(1), 0.0)], "k long, date date, close double")
    assert portfolio.drawdown(levels, "k").first()["drawdown"] is None


def test_oversold_lots(spark):
    trades = [(1, 1, 10.0), (2, 2, -15.0), (3, 3, 8.0), (4, 4, -3.0), (5, 5, 2.0)]
    rows = [("k", i, ISSUE + timedelta(n), q) for i, n, q in trades]
    found = portfolio.fifo_lots(spark.createDataFrame(rows, "key string, trade_id long, date date, quantity double"))
    assert {r["trade_id"]: (r["left"], r["oversold"]) for r in found.collect()} == {1: (0.0, 5.0), 3: (5.0, 5.0), 5: (2.0, 5.0)}


def test_factors_of_one_day_multiply(spark):
    factors = spark.createDataFrame([(1, ISSUE, 0.5), (1, ISSUE, 0.25), (1, ISSUE + timedelta(5), 0.5)], "security_id long, ex_date date, factor double")
    bars = spark.createDataFrame([(1, ISSUE + timedelta(n), 16.0) for n in (-1, 0, 4, 5, 9)], "security_id long, date date, close double")
    assert [r["multiplier"] for r in prices.adjusted_closes(bars, factors).orderBy("date").collect()] == [0.0625, 0.5, 0.5, 1.0, 1.0]


def test_closures():
    assert date(2025, 1, 9) in schedule.us_holidays(2025) and date(2021, 12, 31) not in schedule.us_holidays(2021)
    assert date(2021, 7, 5) in schedule.us_holidays(2021) and date(2021, 6, 18) not in schedule.us_holidays(2021)
    assert {date(2024, 3, 29), date(2024, 5, 27), date(2024, 11, 28)} <= set(schedule.us_holidays(2024))


TEXTS = [
    "Bearer abc.def and sk-abcdefgh1234", "PAN ABCDE1234F, mail a.b@c.co.in", "IN12345678901234", "folio no: 12345678/9", "call 98765-43210 or +91 98765 43210 or 022-1234567",
    "1234 5678 9012 but 2024 2025 2026", "Address: 1 Main Street\nnext line", "total 123456789 and 1.123456789", "１２３４５６７８９０", "nothing 12", "",
]


def test_redaction(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "k long, t string")
    found = {r["k"]: r for r in df.select("k", text.redact(F.col("t")).alias("r"), text.identifiers(F.col("t")).alias("i")).collect()}
    for k, t in enumerate(TEXTS):
        plain = unicodedata.normalize("NFKC", t)
        assert found[k]["i"] == [n for n, p in text.IDENTIFIERS.items() if re.search(p, plain)]
        for pattern in text.IDENTIFIERS.values():
            plain = re.sub(pattern, text.MASK, plain)
        assert found[k]["r"] == plain
    assert found[99]["r"] is None and found[9]["r"] == "nothing 12"
    fields = spark.sql("SELECT map('api-key', 'x', 'dp_id', 'y', 'note', 'mail a@b.co', 'plan', 'z') AS m").select(text.redact_fields(F.col("m")).alias("m")).first()["m"]
    assert fields == {"api-key": text.MASK, "dp_id": text.MASK, "note": f"mail {text.MASK}", "plan": "z"}
