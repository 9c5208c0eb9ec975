"""Sequential operators against plain versions of themselves and hand-built cases."""

from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from ledgerloom.operators import calibration, rebalance, setups


def plain_interval(values, resamples, seed, level):
    state, means, mask = seed, [], (1 << 64) - 1
    for _ in range(resamples):
        total = 0.0
        for _ in range(len(values)):
            state = (state ^ state << 13) & mask
            state ^= state >> 7
            state = (state ^ state << 17) & mask
            total += values[state % len(values)]
        means.append(total / len(values))
    means.sort()
    return means[(100 - level) * resamples // 200], means[min(((100 + level) * resamples + 199) // 200 - 1, resamples - 1)]


@pytest.mark.parametrize("n,resamples,level", [(1, 5, 90), (7, 33, 90), (50, 100, 80), (13, 1, 50)])
def test_bootstrap_steps_as_one_stream(n, resamples, level):
    values = np.random.default_rng(n).normal(size=n)
    assert calibration.bootstrap_interval(values, resamples, 20260101, level) == pytest.approx(plain_interval(list(values), resamples, 20260101, level))


def test_bootstrap_refuses_nothing():
    with pytest.raises(ValueError):
        calibration.bootstrap_interval(np.zeros(0), 10, 1)


def told(spark, rows, least=1):
    schema = "conviction string, n long, hit_pct double, hit_low double, hit_high double"
    return calibration.verdict(spark.createDataFrame(rows, schema), least).collect()[0]["verdict"]


def test_verdicts(spark):
    assert told(spark, [("high", 9, 80.0, 75.0, 85.0), ("medium", 9, 60.0, 55.0, 65.0), ("low", 9, 40.0, 35.0, 45.0)]) == "monotonic"
    assert told(spark, [("high", 9, 80.0, 60.0, 85.0), ("medium", 9, 60.0, 55.0, 65.0)]) == "inconclusive"
    assert told(spark, [("high", 9, 40.0, 35.0, 45.0), ("low", 9, 60.0, 55.0, 65.0)]) == "not monotonic"
    assert told(spark, [("high", 9, 40.0, 35.0, 65.0), ("low", 9, 60.0, 55.0, 65.0)]) == "inconclusive"
    assert told(spark, [("high", 9, 40.0, 35.0, 45.0)]) == "inconclusive"
    assert told(spark, [("high", 9, 40.0, 35.0, 45.0)], 40) == "not enough data"


def test_pivots_are_first_extremes():
    rng = np.random.default_rng(3)
    high, low = rng.integers(50, 60, 80).astype(float), rng.integers(40, 50, 80).astype(float)
    want = set()
    for i in range(3, 77):
        if high[i] == high[i - 3 : i + 4].max() and (high[i - 3 : i] < high[i]).all():
            want.add((i, high[i]))
        if low[i] == low[i - 3 : i + 4].min() and (low[i - 3 : i] > low[i]).all():
            want.add((i, low[i]))
    at, prices = setups.pivots(high, low, 3)
    assert set(zip(at.tolist(), prices.tolist(), strict=True)) == want
    assert len(setups.pivots(high[:6], low[:6], 3)[0]) == 0


def test_clusters_follow_their_mean():
    assert setups.cluster(np.array([100.0, 101.0, 102.4, 110.0]), 1.5) == [(100.5, 2), (102.4, 1), (110.0, 1)]
    assert setups.cluster(np.zeros(0), 1.5) == []


def bars(closes, volumes=None):
    closes = np.asarray(closes, dtype=float)
    return pd.DataFrame({"security_id": "X", "date": [date(2020, 1, 1) + timedelta(days=i) for i in range(len(closes))], "close": closes, "high": closes + 0.5, "low": closes - 0.5, "volume": np.full(len(closes), 100.0) if volumes is None else volumes})


def test_setups():
    assert setups.classify(bars(np.arange(199) + 100.0))["reason"] == "need 200 bars, have 199"
    assert setups.classify(bars(400 - np.arange(260.0)))["setup"] == "downtrend"
    closes = np.full(260, 100.0)
    closes[100:110] += 5 - abs(np.arange(10) - 5)
    closes[-1] = 107.0
    volumes = np.full(260, 100.0)
    volumes[-1] = 300.0
    found = setups.classify(bars(closes, volumes))
    assert found["setup"] == "breakout" and found["entry_low"] == pytest.approx(105.5)
    assert found["stop"] == pytest.approx(found["entry_low"] - 2 * (found["entry_high"] - found["entry_low"]))
    assert setups.classify(bars(closes))["setup"] != "breakout"
    assert setups.classify(bars(100 + 0.01 * np.sin(np.arange(260.0))))["setup"] in ("base", "none")


def test_levels_and_setups_run_by_security(spark):
    rows = pd.concat([bars(100 + 5 * np.sin(np.arange(260) / 6.0)), bars(np.arange(20) + 1.0).assign(security_id="Y")])
    own = spark.createDataFrame(rows)
    found = {(r["side"], r["place"]) for r in setups.levels(own).where("security_id = 'X'").collect()}
    assert {("support", 1), ("resistance", 1)} <= found
    assert {r["security_id"]: r["setup"] for r in setups.setups(own).collect()}["Y"] is None


def position(key, kind, value, flag=None, tax=None):
    return {"key": key, "class": kind, "value": Decimal(value), "flag": flag, "tax_per_unit": None if tax is None else Decimal(tax)}


def moves(spark, held, targets, band, cash, turnover, sold):
    money = "decimal(28,4)"
    rows = [("p", *(x[k] for k in ("class", "key", "value", "flag", "tax_per_unit"))) for x in held]
    positions = spark.createDataFrame(rows, f"portfolio string, class string, key string, value {money}, flag string, tax_per_unit {money}")
    wanted = spark.createDataFrame([("p", c, t) for c, t in targets.items()], f"portfolio string, class string, target_pct {money}")
    settings = spark.createDataFrame([("p", *map(Decimal, (band, cash, turnover, sold)))], f"portfolio string, band {money}, cash {money}, turnover_pct {money}, sold {money}")
    return [tuple(r)[2:] for r in rebalance.propose(positions, wanted, settings).orderBy("step").collect()]


def test_moves(spark):
    targets = {"equity": Decimal(50), "debt": Decimal(50)}
    held = [position("x", "equity", 700, tax="0.1"), position("y", "equity", 100, "EXIT"), position("z", "debt", 200)]
    assert moves(spark, held, targets, 5, 0, 100, 0) == [("reduce", "equity", "y", Decimal(100)), ("reduce", "equity", "x", Decimal(150)), ("add", "debt", None, Decimal(250))]
    assert moves(spark, held, targets, 5, 0, 20, 50) == [("reduce", "equity", "y", Decimal(100)), ("reduce", "equity", "x", Decimal(50)), ("add", "debt", None, Decimal(150))]
    assert moves(spark, held, targets, 5, 600, 0, 0) == [("add", "debt", None, Decimal(600))]
    assert moves(spark, held, {}, 5, 0, 20, 0) == []
    assert moves(spark, [], targets, 5, 9, 20, 0) == []
    assert moves(spark, [*held, position("g", "gold", 500)], targets, 50, 0, 20, 0) == []
    # three equal weights of 100: the last by name takes the cent that the cuts leave
    thirds = {c: Decimal(30) for c in "abc"}
    even = [position(c, c, 100) for c in "abc"]
    assert moves(spark, even, thirds, 90, 100, 0, 0) == [("add", "a", None, Decimal("33.33")), ("add", "b", None, Decimal("33.33")), ("add", "c", None, Decimal("33.34"))]
    # reductions by trim, tax and unknown tax, over two classes, the one further over first
    two = [position("q", "e", 500), position("r", "e", 300, tax="0.2"), position("s", "e", 200, tax="0.1"), position("t", "f", 700, "TRIM"), position("u", "g", 0)]
    assert moves(spark, two, {"e": Decimal(20), "f": Decimal(20), "g": Decimal(60)}, 5, 0, 50, 0) == [
        ("reduce", "e", "s", Decimal(200)), ("reduce", "e", "r", Decimal(300)), ("reduce", "e", "q", Decimal(75)), ("reduce", "f", "t", Decimal(275)), ("add", "g", None, Decimal(850)),
    ]
