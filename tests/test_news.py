"""Stories against a plain greedy pass, on whole tables and odd rows."""

import random
import re
from datetime import datetime, timedelta, timezone
from difflib import SequenceMatcher
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph, news, text
from ledgerloom.plans.stories import news_items

SCHEMA = "item_id long, title string, url string, published timestamp, source string, security_id long, kind string"
START = datetime(2026, 3, 1, tzinfo=timezone.utc)


def plain_title(title, source):
    found = (title or "").rstrip()
    if source and found.lower().endswith(source.lower()):
        head = found[: len(found) - len(source)].rstrip()
        found = head[:-1] if head[-1:] in tuple("-|–—") else found
    return " ".join(re.findall("[a-z0-9]+", found.lower()))


def plain_url(url):
    if not url:
        return ""
    p = urlsplit(url.strip())
    pairs = sorted(kv for kv in parse_qsl(p.query) if not kv[0].lower().startswith("utm_"))
    return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/") or ("" if p.query else "/"), urlencode(pairs), ""))


def same(a, b):
    if a["url"] and a["url"] == b["url"]:
        return True
    if abs(a["published"] - b["published"]) > timedelta(hours=48):
        return False
    if "announcement" in (a["kind"], b["kind"]) and (a["security_id"] is None or a["security_id"] != b["security_id"]):
        return False
    if not (a["title"] and b["title"]):
        return False
    pair = SequenceMatcher(None, a["title"], b["title"])
    # the quick ratios are upper bounds
    return pair.real_quick_ratio() >= 0.9 and pair.quick_ratio() >= 0.9 and pair.ratio() >= 0.9


def greedy(rows, stored=()):
    prepared = [[dict(r, url=plain_url(r["url"]), title=plain_title(r["title"], r["source"])) for r in part if r["published"]] for part in (rows, stored)]
    kept = []
    for r in sorted(prepared[0], key=lambda r: (r["published"], r["item_id"])):
        if any(same(r, e) for e in prepared[1]):
            continue
        twin = next((k for k in kept if same(r, k[0])), None)
        if twin is None:
            kept.append((r, set(), [0]))
        else:
            twin[2][0] += 1
            twin[1].update({r["source"]} - {twin[0]["source"], None})
    return sorted((r["item_id"], sorted(also), n) for r, also, (n,) in kept)


def found(df, stored=None):
    return sorted((r["item_id"], r["also"], r["folded"]) for r in news.dedupe_news(df, stored).collect())


def dicts(df):
    return [r.asDict() for r in df.collect()]


def odd_items(seed, n=260):
    rnd = random.Random(seed)
    base = ["Acme Ltd posts record quarterly profit on strong demand", "Board of Zenith to consider bonus issue", "Q3", "ab", "Rupee falls", "Court rejects plea of Orion over licence, shares slip"]
    rows = []
    for i in range(n):
        title = rnd.choice(base)
        for _ in range(rnd.randrange(5)):
            k = rnd.randrange(max(1, len(title)))
            title = title[:k] + rnd.choice(["", "x", " ", title[k : k + 1] * 2]) + title[k + rnd.randrange(2) :]
        source = rnd.choice(["Mint", "Wire", "e-Paper (IN)", None])
        if source and rnd.random() < 0.4:
            title += rnd.choice([" - ", " | ", "—", " "]) + source.upper()
        url = rnd.choice([None, "", f"https://Ex.com/{rnd.randrange(60)}/?utm_source=a&b=2&a=1#top", f"https://ex.com/{rnd.randrange(60)}?a=1&b=2"])
        rows.append((i, rnd.choice([title] * 9 + [None]), url, START + timedelta(minutes=rnd.randrange(60 * 24 * 9)), source, rnd.choice([1, 2, None]), rnd.choice(["news", "news", "announcement", None])))
    return rows + [(n, "no time", None, None, "Mint", None, "news"), (n + 1, "", "", START, None, None, None)]


@pytest.mark.parametrize("seed", [1])
def test_stories_of_odd_items(spark, seed):
    df = spark.createDataFrame(odd_items(seed), SCHEMA).withColumns({"story": F.lit("x"), "cell": F.lit(1)}).repartition(5)
    assert found(df) == greedy(dicts(df))
    stored = spark.createDataFrame(odd_items(seed + 10, 40), SCHEMA)
    assert found(df, stored) == greedy(dicts(df), dicts(stored))


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_stories_of_whole_tables(spark, sf):
    df = news_items(spark, f"/root/testdata/{sf}")
    result = found(df)
    assert result == greedy(dicts(df))
    assert any(r[1] for r in result) and any(r[2] for r in result)


def test_stories_without_items(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == [] and found(empty, empty) == []


def test_one_title_all_the_time(spark):
    """A third of all rows may carry one title; each 48 hours keep one."""
    df = spark.range(3_000).select(F.col("id").alias("item_id"), F.lit("Market closes higher").alias("title"), F.lit(None).cast("string").alias("url"), (F.lit(START) + F.make_dt_interval(mins=F.col("id") * 10)).alias("published"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.lit(None).cast("long").alias("security_id"), F.lit("news").alias("kind"))
    assert found(df) == greedy(dicts(df))


def test_addresses(spark):
    urls = ["HTTPS://Www.Example.COM", "http://a.com/", "http://a.com/x//?b=&a=%7e1&c=a+b%20c*&UTM_x=1#f", "a.com/path/", "http://a.com?z=1", "http://a.com/%41?q=%zz&é=ü&q=a%26b", "", None, "http://a.com/?x", "https://h/p?b=2&a=1&a=0"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", text.canonical_url(F.col("u")).alias("c")).collect()
    assert [r["c"] for r in rows if r["u"] is not None] == [plain_url(r["u"]) for r in rows if r["u"] is not None]


def test_titles(spark):
    cases = [("Apple - profits rise", "Mint"), ("Apple - profits rise - MINT ", "Mint"), ("Mint", "Mint"), ("A|Mint", "Mint"), ("A – x.y", "x.y"), ("Ärger — Ünï", "Ünï"), (None, "Mint"), ("B - s - s", "s"), ("C", None), ("", "")]
    rows = spark.createDataFrame(cases, "t string, s string").select("t", "s", text.normalised_title(F.col("t"), F.col("s")).alias("n")).collect()
    assert [r["n"] for r in rows if r["t"] is not None] == [plain_title(r["t"], r["s"]) for r in rows if r["t"] is not None]


def test_groups_and_chains(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(60)] + [(9, 9), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["group"] for r in graph.groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    rows = [(i, i + 1 if i < 60 else None) for i in range(61)] + [(300, 300), (301, 999), (400, 401), (401, 402), (402, 400), (403, 400), (500, 0), (501, 500)]
    last = {r["id"]: r["last"] for r in graph.chain_ends(spark.createDataFrame(rows, "id long, after long"), "id", "after").collect()}
    assert last == {**{i: 60 for i in range(61)}, 300: 300, 301: 301, 400: None, 401: None, 402: None, 403: None, 500: 60, 501: 60}
