"""Every query against the same SQL in DuckDB, on the smallest test data."""

import os

import duckdb
import pytest

from ledgerloom import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    found = plans.QUERIES[name](spark, SF)
    wanted = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(wanted.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["security_id", "date", "price_vs_sma", "rs_percentile"]
