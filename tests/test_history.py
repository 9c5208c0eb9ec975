"""Figures known at each month end and where today's multiples stand, against plain Python on odd filings."""

import random
from datetime import date, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import history

FILINGS = "security_id int, item string, period_type string, period_end date, value double, filed_at date"
CLOSES = "security_id int, date date, close double"
ITEMS = [*history.NEWEST, *history.YEARLY]
AS_OF = date(2020, 6, 17)


def quarter_end(k):
    y, q = divmod(k, 4)
    return [date(y, 3, 31), date(y, 6, 30), date(y, 9, 30), date(y, 12, 31)][q]


def odd_filings(seed):
    """Late, early, repeated and restated filings, gaps, zeros, losses and nulls."""
    rnd = random.Random(seed)
    rows = []
    for s in range(4):
        for k in range(2012 * 4, 2020 * 4 + 2):
            for item in ITEMS:
                for kind, end in [("Q", quarter_end(k))] + ([("A", quarter_end(k))] if k % 4 == 3 else []):
                    for _ in range(rnd.choice([0, 1, 1, 1, 2])):
                        value = rnd.choice([None, 0.0, -3.0] + [round(rnd.uniform(1, 90), 2)] * 9)
                        filed = end + timedelta(days=rnd.choice([-20, 10, 30, 45, 45, 200, 700]))
                        rows.append((s, item, kind, end, value, filed))
    return rows + rows[:20] + [(0, "eps", "Q", None, 1.0, AS_OF), (0, "eps", "Q", AS_OF, 1.0, None), (9, "eps", "A", date(2018, 12, 31), 4.0, date(2019, 2, 1))]


def odd_closes(seed):
    rnd = random.Random(seed)
    rows = [(s, date(2013 + m // 12, m % 12 + 1, d), rnd.choice([None, *[round(rnd.uniform(5, 500), 2)] * 8])) for s in range(4) for m in range(6 * s, 96) for d in (3, 17, 26)]
    return rows + [(7, date(2019, 5, 5), 10.0)]


def known(filings, security, day):
    newest = {}
    for s, item, kind, end, value, filed in filings:
        if s == security and None not in (end, value, filed) and filed <= day and end <= day:
            key = (item, kind, end)
            newest[key] = max(newest.get(key, (filed, value)), (filed, value))
    facts = dict.fromkeys(ITEMS)
    for item in ITEMS:
        options = [(end, kind == "A", v) for (i, kind, end), (_, v) in newest.items() if i == item and (kind == "A" or item in history.NEWEST)]
        facts[item] = max(options)[2] if options else None
    quarters = sorted(((end, v) for (i, kind, end), (_, v) in newest.items() if i == "eps" and kind == "Q"), reverse=True)[:4]
    if len(quarters) == 4 and 240 <= (quarters[0][0] - quarters[3][0]).days <= 300:
        facts["eps"] = sum(v for _, v in quarters)
    facts["capex"] = None if facts["capex"] is None else abs(facts["capex"])
    return facts


def multiples(f, price, market, financial):
    cap = None if f["shares_out"] is None else price * f["shares_out"]
    ebitda = None if None in (f["operating_income"], f["depreciation_amortization"]) else f["operating_income"] + f["depreciation_amortization"]
    out = dict.fromkeys(history.MULTIPLES)
    if f["eps"] is not None and f["eps"] > 0:
        out["pe"] = price / f["eps"]
    if cap is not None and f["total_equity"] is not None and f["total_equity"] > 0:
        out["pb"] = cap / f["total_equity"]
    if not financial and market != "IN" and None not in (cap, ebitda, f["total_debt"], f["cash"]) and ebitda > 0:
        out["ev_ebitda"] = (cap + f["total_debt"] - f["cash"]) / ebitda
    if not financial and None not in (cap, f["cfo"], f["capex"]) and cap:
        out["fcf_yield_pct"] = 100 * (f["cfo"] - f["capex"]) / cap
    if f["dividends_per_share"] is not None:
        out["dividend_yield_pct"] = 100 * f["dividends_per_share"] / price
    return {m: None if v is None else round(v, 8) for m, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_history(spark, seed):
    filings, closes = odd_filings(seed), odd_closes(seed)
    about = {0: ("US", "general"), 1: ("IN", "general"), 2: ("US", "financial"), 3: ("US", "general"), 7: (None, None)}
    securities = spark.createDataFrame([(s, *a) for s, a in about.items()], "security_id int, market string, sector_kind string")
    found = history.valuation_history(spark.createDataFrame(filings, FILINGS).repartition(3), spark.createDataFrame(closes, CLOSES), securities, AS_OF.isoformat(), years=(2, 5, 10))
    got = {(r["security_id"], r["multiple"]): r for r in found.collect()}
    assert len(got) == 5 * 5
    for s, (market, kind) in about.items():
        prices = [(d, c) for i, d, c in closes if i == s and c is not None and d <= AS_OF]
        ends = {(d.year, d.month): (d, c) for d, c in sorted(prices)}
        now = multiples(known(filings, s, AS_OF), max(prices)[1], market, kind == "financial")
        past = [(d, multiples(known(filings, s, d), c, market, kind == "financial")) for d, c in ends.values()]
        for m in history.MULTIPLES:
            row = got[s, m]
            assert row["current"] == pytest.approx(now[m], abs=1e-7) and (row["reason"] is None) == (now[m] is not None)
            for n in (2, 5, 10):
                start = AS_OF.replace(year=AS_OF.year - n)
                values = [(d, v[m]) for d, v in past if d > start and v[m] is not None]
                whole = len(values) >= 24 and values[0][0] <= start + timedelta(days=62)
                assert row[f"observations_{n}y"] == len(values)
                assert row[f"median_{n}y"] == (pytest.approx(median(v for _, v in values), abs=1e-7) if whole else None)
                share = 100 * sum(v <= now[m] for _, v in values) / len(values) if whole and now[m] is not None else None
                assert row[f"percentile_{n}y"] == (None if share is None else pytest.approx(share, abs=1e-6))
                assert (row[f"reason_{n}y"] is None) == (share is not None)


def test_history_without_rows(spark):
    filings, closes = spark.createDataFrame([], FILINGS), spark.createDataFrame([], CLOSES)
    securities = spark.createDataFrame([(1, "US", "general")], "security_id int, market string, sector_kind string")
    assert history.valuation_history(filings, closes, securities, "2020-01-01").count() == 0
    one = spark.createDataFrame([(1, date(2019, 1, 1), 0.0)], CLOSES)
    rows = history.valuation_history(filings, one, securities.where(F.lit(False)), "2020-01-01").collect()
    assert len(rows) == 5 and all(r["current"] is None and r["reason"] for r in rows)
