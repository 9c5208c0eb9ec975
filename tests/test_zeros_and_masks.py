"""Prices and ratios of zero, corrected decisions, and masks in nested fields."""

import json
from datetime import date

from ledgerloom.operators import indicators, prices, returns, text

BARS = "security_id string, date date, open double, high double, low double, close double, volume double"


def test_gaps_from_zero(spark):
    rows = [("a", date(2025, 1, d), p, p, p, p, 1.0) for d, p in enumerate([0.0, 5.0, 0.0, 10.0, 20.0], 1)]
    found = indicators.gap_zones(spark.createDataFrame(rows, BARS), 2.0).collect()
    assert [(r["date"].day, r["side"], r["low_edge"], r["high_edge"]) for r in found] == [(5, "up", 10.0, 20.0)]


def test_factors_of_zero(spark):
    bars = spark.createDataFrame([("a", date(2025, 1, 1), 1.0, 1.0, 1.0, 100.0, 1.0)], BARS)
    actions = spark.createDataFrame([("a", date(2025, 2, d), k, v, 1) for d, (k, v) in enumerate([("split", 0.0), ("bonus", -1.0), ("split", 4.0)], 1)], "security_id string, ex_date date, kind string, value double, source_rank int")
    factors = prices.price_factors(actions, bars)
    assert {(r["ex_date"].day, r["factor"]) for r in factors.collect()} == {(1, None), (2, None), (3, 0.25)}
    assert [r["adj_close"] for r in prices.adjusted_closes(bars, factors).collect()] == [25.0]


def test_corrected_decisions_are_not_sold(spark):
    rows = [(1, None, 7, "acted", date(2025, 3, 1), 10.0, 2.0, "INR"), (2, 1, 7, "acted", date(2025, 3, 2), 4.0, 2.0, "INR"), (3, None, 7, "skipped", date(2025, 3, 3), 9.0, 9.0, "INR")]
    decisions = spark.createDataFrame(rows, "id long, corrects_id long, entry_id long, decision string, on_date date, qty double, price double, currency string")
    calls = spark.createDataFrame([(7, "SELL")], "entry_id long, verdict string")
    row = returns.sold_in_year(decisions, calls, 2025, 80.0).first()
    assert (row["amount"], row["rows"]) == (8.0, 1)
    assert returns.sold_in_year(decisions.drop("corrects_id"), calls, 2025, 80.0).first()["rows"] == 2


def test_masks_in_fields(spark):
    wide = "call ９８７６５ ４３２１０"  # full-width digits
    doc = {"user": {"api-key": "x", "notes": ["mail a@b.co", {"PAN": None, "plan": "ok", "n": 5, "phone": [1, 2]}]}, "say": wide}
    rows = spark.createDataFrame([(json.dumps(doc), wide), ("not json a@b.co", None), (None, None), ('"a@b.co"', ""), ("[]", "x")], "j string, t string")
    got = [r["m"] for r in rows.select(text.redact_json("j").alias("m")).collect()]
    assert json.loads(got[0]) == {"user": {"api-key": "[REDACTED]", "notes": ["mail [REDACTED]", {"PAN": None, "plan": "ok", "n": 5, "phone": "[REDACTED]"}]}, "say": "call [REDACTED]"}
    assert got[1:] == ["not json [REDACTED]", None, '"[REDACTED]"', "[]"]
    fields = spark.createDataFrame([({"note": wide, "token": "t", "none": None},), (None,)], "m map<string,string>")
    assert [r["m"] for r in fields.select(text.redact_fields("m").alias("m")).collect()] == [{"note": "call [REDACTED]", "token": "[REDACTED]", "none": None}, None]
