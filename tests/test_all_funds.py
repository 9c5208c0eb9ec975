"""The fund queries over every supplier of a small fixture, against brute force."""

from collections import defaultdict

import pytest

from ledgerloom import plans

FUNDS = range(1, 46)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("funds"))
    lines = [(f, 7 * f + 3 * k, 100.0 + 10 * f + k) for f in FUNDS for k in range(5)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(f, 50.0 * f - 200) for f in FUNDS], "s_suppkey long, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
    value = defaultdict(lambda: defaultdict(float))
    for f, part, price in lines:
        value[f][part % 40] += price
    return path, {f: {i: 100 * v / sum(own.values()) for i, v in own.items()} for f, own in value.items()}


def test_overlap_of_all_funds(spark, tables):
    path, weights = tables
    found = {(r["fund"], r["other"]): (r["overlap"], r["common"]) for r in plans.QUERIES["mf_overlap"](spark, path).collect()}
    wanted = {}
    for a in FUNDS:
        for b in range(a + 1, FUNDS[-1] + 1):
            if both := weights[a].keys() & weights[b].keys():
                wanted[a, b] = (pytest.approx(sum(min(weights[a][i], weights[b][i]) for i in both), abs=1e-5), len(both))
    assert found == wanted


def test_look_through_of_all_funds(spark, tables):
    path, weights = tables
    exposure, funds = defaultdict(float), defaultdict(int)
    for f in FUNDS:
        for i, w in weights[f].items():
            exposure[i] += w * (50.0 * f - 200) / 100
            funds[i] += 1
    top = sorted(exposure, key=lambda i: (-exposure[i], i))[:20]
    found = {r["isin"]: (r["exposure"], r["funds"]) for r in plans.QUERIES["mf_look_through"](spark, path).collect()}
    assert found == {i: (pytest.approx(exposure[i], abs=1e-3), funds[i]) for i in top}


def test_multiple_of_all_funds(spark, tables):
    path, weights = tables
    wanted = {}
    for f, own in weights.items():
        known = {i: w for i, w in own.items() if i % 5}
        coverage = sum(known.values())
        multiple = coverage / sum(w / (10 + i) for i, w in known.items()) if coverage >= 60 else None
        wanted[f] = (pytest.approx(coverage, abs=1e-5), multiple and pytest.approx(multiple, abs=1e-5))
    assert {r["fund"]: (r["coverage"], r["multiple"]) for r in plans.QUERIES["mf_weighted_multiple"](spark, path).collect()} == wanted
