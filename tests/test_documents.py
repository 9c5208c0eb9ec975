"""Readers of documents, and names against brute force."""

from datetime import date, datetime
from decimal import Decimal
from difflib import SequenceMatcher

from ledgerloom.operators import names
from ledgerloom.sources import documents

RSS = """<rss version="2.0"><channel><title>W</title><item><title>One</title><link>http://x/1</link><pubDate>Mon, 05 Jan 2026 09:00:00 +0530</pubDate><description>&lt;p&gt;a &lt;b&gt;b&lt;/b&gt;&lt;/p&gt;</description></item>
<item><title>Two</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Three</title><link href="http://y/3"/><published>2026-01-05T15:30:00+05:30</published><updated>2026-01-06T00:00:00Z</updated></entry></feed>"""
XBRL = """<x:xbrl xmlns:x="i" xmlns:f="f"><x:context id="Q"><x:period><x:startDate>2025-10-01</x:startDate><x:endDate>2025-12-31</x:endDate></x:period></x:context>
<x:context id="S"><x:entity><x:segment>a</x:segment></x:entity><x:period><x:startDate>2025-10-01</x:startDate><x:endDate>2025-12-31</x:endDate></x:period></x:context>
<x:context id="I"><x:period><x:instant>2025-12-31</x:instant></x:period></x:context><x:context id="H"><x:period><x:startDate>2025-07-01</x:startDate><x:endDate>2025-12-31</x:endDate></x:period></x:context>
<x:unit id="INRLakhs"/><f:NatureOfReportStandaloneConsolidated>Consolidated</f:NatureOfReportStandaloneConsolidated>
<f:RevenueFromOperations contextRef="Q" unitRef="INRLakhs">12.5</f:RevenueFromOperations><f:InterestEarned contextRef="Q" unitRef="INRLakhs">99</f:InterestEarned>
<f:RevenueFromOperations contextRef="S" unitRef="INRLakhs">1</f:RevenueFromOperations><f:Equity contextRef="I">7</f:Equity><f:NetInterestMargin contextRef="Q" unitRef="INRLakhs">3.1</f:NetInterestMargin>
<f:ProfitLossForPeriod contextRef="H">5</f:ProfitLossForPeriod></x:xbrl>"""


def put(folder, name, text):
    (folder / name).write_text(text)


def test_feeds(spark, tmp_path):
    for name, text in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", "<!DOCTYPE x><rss/>"), ("d.xml", "<rss>"), ("e.xml", "<other/>")):
        put(tmp_path, name, text)
    rows = {(r["title"], r["error"]): r for r in documents.feed(spark, str(tmp_path)).collect()}
    assert set(rows) == {("One", None), ("Two", "no date or title"), ("Three", None), (None, "declarations are not accepted"), (None, "malformed"), (None, "not a feed")}
    assert rows["One", None]["published"] == datetime(2026, 1, 5, 3, 30) and rows["One", None]["summary"] == "a b"
    assert rows["Three", None]["published"] == datetime(2026, 1, 5, 10, 0) and rows["Three", None]["url"] == "http://y/3"


def test_results(spark, tmp_path):
    put(tmp_path, "r.xml", XBRL)
    put(tmp_path, "bad.xml", XBRL.replace("12.5", "n/a"))
    rows = documents.results(spark, str(tmp_path)).collect()
    found = {r["item"]: (r["period_type"], r["value"], r["basis"]) for r in rows if r["error"] is None}
    assert found == {"revenue": ("Q", Decimal(1250000), "consolidated"), "total_equity": ("Q", Decimal(7), "consolidated"), "nim_pct": ("Q", Decimal("3.1"), "consolidated")}
    assert [r["error"] for r in rows if r["error"]] == ["bad number in RevenueFromOperations"]
    both = spark.createDataFrame([(1, "standalone"), (1, "consolidated"), (2, "standalone")], "period_end int, basis string")
    assert {(r["period_end"], r["basis"]) for r in documents.prefer_consolidated(both).collect()} == {(1, "consolidated"), (2, "standalone")}


def test_json_and_masters(spark, tmp_path):
    put(tmp_path, "s.json", '[{"quarter_end": "2025-12-31", "filed_at": "2026-01-20", "promoter_pct": "50.1", "promoter_pledged_pct": "-", "public_pct": 49.9}]')
    (row,) = documents.shareholding(spark, str(tmp_path / "s.json")).collect()
    assert (row["period_end"], row["promoter_pct"], row["promoter_pledged_pct"], row["public_pct"]) == (date(2025, 12, 31), Decimal("50.1"), None, Decimal("49.9"))
    put(tmp_path, "f.json", '[{"category": "FII/FPI *", "date": "05-Jan-2026", "buyValue": "1,000.5", "sellValue": "900", "netValue": "100.5"}]')
    (row,) = documents.flows(spark, str(tmp_path / "f.json")).collect()
    assert (row["who"], row["date"], row["bought"]) == ("fii", date(2026, 1, 5), Decimal("1000.5"))
    put(tmp_path, "t.json", '{"fields": ["cik", "name", "ticker", "exchange"], "data": [[320193, "Apple Inc.", "aapl", "Nasdaq"]]}')
    (row,) = documents.exchange_tickers(spark, str(tmp_path / "t.json")).collect()
    assert (row["cik"], row["symbol"], row["exchange"]) == ("0000320193", "AAPL", "Nasdaq")
    put(tmp_path, "l.csv", "SYMBOL,NAME OF COMPANY, SERIES, ISIN NUMBER\nAAA,Aaa Limited,EQ,INE000A01010\n")
    (row,) = documents.listed_equities(spark, str(tmp_path / "l.csv")).collect()
    assert (row["symbol"], row["series"], row["isin"]) == ("AAA", "EQ", "INE000A01010")


SECURITIES = [(1, "INE000A01010", "AAA", "Alpha Steel Limited"), (2, "INE000B01018", "BBB", "Alpha Steels & Power Ltd"), (3, None, "CCC", "Gamma Bank"), (4, None, "DDD", "Gamma Banks"), (5, None, "EEE", None)]


def test_lookup(spark):
    known = spark.createDataFrame(SECURITIES, "security_id int, isin string, symbol string, name string")
    asked = [(1, "id:3"), (2, "ine000b01018"), (3, "ccc"), (4, "Alpha Steel Ltd."), (5, "gamma bank inc"), (6, "nothing here"), (7, "id:99"), (8, None), (9, ""), (10, "gamma")]
    found = {r["query_id"]: (r["how"], r["security_id"], r["candidates"]) for r in names.lookup(spark.createDataFrame(asked, "query_id int, text string"), known).collect()}
    assert {k: v[:2] for k, v in found.items() if k < 5} == {1: ("id", 3), 2: ("isin", 2), 3: ("symbol", 3), 4: ("name", 1)}
    assert found[5][0] == "name" and found[5][2][0] == 3
    clear = SequenceMatcher(None, "gamma bank", "gamma bank").ratio() - round(SequenceMatcher(None, "gamma bank", "gamma banks").ratio(), 4) >= 0.05
    assert found[5][1] == (3 if clear or found[5][2] == [3] else None)
    assert found[10][1] is None and found[10][2] == [3, 4]
    assert all(found[k] == (None, None, None) for k in (6, 7, 8, 9))


def test_tags(spark):
    known = spark.createDataFrame(SECURITIES, "security_id int, isin string, symbol string, name string")
    items = [(1, "Why Alpha Steel rose"), (2, "AAA and BBB fall"), (3, "aaa falls"), (4, "CCC up"), (5, None), (6, "Gamma Bank and CCC")]
    assert {r["item_id"]: r["security_id"] for r in names.tag(spark.createDataFrame(items, "item_id int, title string"), known).collect()} == {1: 1, 2: None, 3: None, 4: 3, 5: None, 6: 3}
