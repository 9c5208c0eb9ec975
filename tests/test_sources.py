"""Readers, writers and streams over small files made here."""

import json
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.sources import files, tables
from ledgerloom.streaming import alerts


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_bhavcopy_keeps_series_and_names_faults(spark, tmp_path):
    head = "TradDt,ISIN,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol\n"
    path = write(tmp_path, "b.csv", head + "2026-01-05,INE1,AAA,EQ,10,12,9,11,100\n2026-01-05,INE2,BBB,EQ,10,8,9,9,1\n2026-01-05,INE3,CCC,GS,1,1,1,1,1\n2026-01-05,INE4,DDD,BE,10,12,9,-,1\n")
    rows = {r["symbol"]: r for r in files.bhavcopy(spark, path).collect()}
    assert set(rows) == {"AAA", "BBB", "DDD"}
    assert rows["AAA"]["fault"] is None and rows["AAA"]["close"] == Decimal("11") and rows["AAA"]["date"] == date(2026, 1, 5)
    assert rows["BBB"]["fault"] == "high below low" and rows["DDD"]["fault"] == "missing"
    assert files.bhavcopy(spark, path, None).count() == 4


def test_indices_and_daily_files(spark, tmp_path):
    head = "Index Name,Index Date,Open Index Value,High Index Value,Low Index Value,Closing Index Value,Volume\n"
    (row,) = files.index_closes(spark, write(tmp_path, "i.csv", head + "Big Fifty,05-01-2026,-,2,1,1.5,-\n")).collect()
    assert (row["name"], row["date"], row["open"], row["close"], row["volume"]) == ("BIG FIFTY", date(2026, 1, 5), None, Decimal("1.5"), None)
    (row,) = files.daily_csv(spark, write(tmp_path, "d.csv", "Date,Open,High,Low,Close,Volume\n2026-01-05,1,3,1,2,9\n")).collect()
    assert (row["close"], row["volume"]) == (Decimal("2"), 9)


def test_corporate_actions(spark, tmp_path):
    subjects = ["Bonus 3:1", "Face Value Split From Rs 10/- Per Share To Rs 2/- Per Share", "Interim Dividend - Rs 7.50 Per Share", "Annual General Meeting"]
    path = write(tmp_path, "c.json", [{"symbol": "A", "subject": s, "exDate": "05-Jan-2026"} for s in subjects] + [{"symbol": "A", "subject": "Bonus 1:1", "exDate": "-"}])
    rows = {r["kind"]: r for r in files.corporate_actions(spark, path).collect()}
    assert set(rows) == {"bonus", "split", "dividend"}
    assert rows["bonus"]["ratio"] == 3 and rows["split"]["ratio"] == 5 and rows["dividend"]["amount"] == Decimal("7.5")


def test_funds_and_series(spark, tmp_path):
    text = "Scheme Code;a;b;Name;NAV;Date\n\nOpen Ended\n1;x;y;One;10.5;05-Jan-2026\n2;x;y;Two;N.A.;05-Jan-2026\nz;x;y;Three;1;05-Jan-2026\n3;x;y;Four;0;05-Jan-2026\n"
    rows = {r["name"]: r["fault"] for r in files.nav_text(spark, write(tmp_path, "n.txt", text)).collect()}
    assert rows == {"One": None, "Two": "no value", "Three": "malformed", "Four": "not positive"}
    path = write(tmp_path, "h.json", {"meta": {"scheme_code": "7"}, "data": [{"date": "02-01-2026", "nav": "2.5"}, {"date": "01-01-2026", "nav": "0"}]})
    assert [(r["scheme"], r["nav"]) for r in files.nav_history(spark, path).collect()] == [("7", Decimal("2.5"))]
    path = write(tmp_path, "f.json", {"amfi_code": "9", "months": [{"month_end": "2026-01-31", "holdings": [{"isin": "I", "name": "N", "weight_pct": "30.50", "asset_type": "equity"}]}]})
    assert files.fund_holdings(spark, path).first()["weight_pct"] == Decimal("30.5")
    path = write(tmp_path, "o.json", {"observations": [{"date": "2026-01-01", "value": "."}, {"date": "2026-01-02", "value": "-0.1"}]})
    assert [r["value"] for r in files.observations(spark, path).orderBy("date").collect()] == [None, Decimal("-0.1")]


def test_facts_and_chart(spark, tmp_path):
    facts = {"facts": {"us": {"Revenue": {"units": {"USD": [{"start": "2025-01-01", "end": "2025-12-31", "val": 5, "filed": "2026-02-01", "form": "10-K"}, {"end": "2025-12-31", "filed": "2026-02-01"}]}}}}}
    (row,) = files.company_facts(spark, write(tmp_path, "e.json", facts)).collect()
    assert (row["concept"], row["value"], row["form"]) == ("Revenue", 5, "10-K")
    quote = {"open": [1.0, 1.0], "high": [2.0, 2.0], "low": [1.0, 1.0], "close": [1.5, None], "volume": [7, 8]}
    body = {"chart": {"result": [{"meta": {"gmtoffset": 19800}, "timestamp": [1767571200, 1767657600], "indicators": {"quote": [quote]}}]}}
    (row,) = files.chart(spark, write(tmp_path, "y.json", body)).collect()
    assert (row["date"], row["close"], row["volume"]) == (date(2026, 1, 5), Decimal("1.5"), 7)


def test_holdings_template_and_preset(spark, tmp_path):
    head = "account_label,isin,symbol,exchange,quantity,avg_cost,currency,asset_class\n"
    path = write(tmp_path, "t.csv", head + 'B,INE000A01010,,,"1,234","2,450.50",INR,equity\n,INE000A01010,,,1,1,,\nB,,,,1,1,,\nB,BAD,,,1,1,,\nB,,X,,0,1,,\nB,,Y,,1,,,cash\nB,,Z,,1,,,\n')
    rows = files.holdings_csv(spark, path).collect()
    assert [r["error"] for r in rows] == [None, "account_label is empty", "needs an isin or a symbol", "isin is not valid", None, "avg_cost is required"]
    assert rows[0]["quantity"] == 1234 and rows[0]["avg_cost"] == Decimal("2450.5")
    (row,) = files.holdings_csv(spark, write(tmp_path, "z.csv", "Instrument,Qty.,Avg. cost\nAAA,3,4\n"), "zerodha", "Mine").collect()
    assert (row["account_label"], row["symbol"], row["quantity"], row["error"]) == ("Mine", "AAA", 3, None)


def test_writers(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "id int, part string, value double")
    fresh = spark.createDataFrame([(2, "b", 5.0), (3, "b", 6.0)], stored.schema)
    read = lambda p: sorted((r["id"], r["value"]) for r in spark.read.parquet(p).collect())
    by_key, added, parts = (str(tmp_path / n) for n in ("k", "n", "p"))
    tables.replace_by_key(stored, fresh, ["id"], by_key)
    assert read(by_key) == [(1, 1.0), (2, 5.0), (3, 6.0)]
    stored.write.parquet(added)
    tables.append_new(stored, fresh, ["id"], added)
    assert read(added) == [(1, 1.0), (2, 2.0), (3, 6.0)]
    tables.replace_partitions(stored.unionByName(fresh), ["part"], parts)
    tables.replace_partitions(fresh.where("id = 3"), ["part"], parts)
    assert read(parts) == [(1, 1.0), (2, 2.0), (3, 6.0)]


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("A", "2026-01-05 10:00:00"), ("A", "2026-01-05 11:00:00"), ("A", "2026-01-06 10:00:00"), ("B", "2026-01-05 10:00:00")]
    spark.createDataFrame(rows, "id string, at string").select("id", F.col("at").cast("timestamp").alias("at")).write.parquet(folder)
    stream = spark.readStream.schema("id string, at timestamp").parquet(folder)
    for name, out, mode in (("first", alerts.first_alerts(stream, ["id"], "at", "2 days"), "append"), ("calls", alerts.calls_by_window(stream, "at", "1 day", "2 days", "id"), "complete")):
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("first").count() == 3
    assert sorted(r["calls"] for r in spark.table("calls").collect()) == [1, 1, 2]
    assert alerts.newest_by_key(spark.read.parquet(folder), ["id"], "at").count() == 2
