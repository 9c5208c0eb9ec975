"""Operators 11 to 13 against brute force, SQL and held-out labels, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, hardnegatives, queries, toxicity

SF = "/root/testdata/sf0.001"


def against_sql(spark, name, sf=SF):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    wanted = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    found = queries.QUERIES[name](spark, sf).select(columns).collect()
    rows = sorted(map(str, wanted.fetchall()))
    assert rows and sorted(map(str, map(tuple, found))) == rows


# ---- phrases ----
def brute_phrases(rows, least, longest, top):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            words[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    counts[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        held = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        for p, a in held.items():
            cuts = [(1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            if not any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in held.items()):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def odd_texts():
    rnd = random.Random(5)
    some = ["alpha", "beta", "gamma", "Straße", "x1", "%%", "a|b", "\x00z"]
    rows = [("en", " ".join(rnd.choice(some) + rnd.choice(["", "", ",", ".", "\n"]) for _ in range(60))) for _ in range(40)]
    rows += [("en", None), (None, ""), (None, "One two\tthree one  two three"), ("de", "aa aa aa aa aa aa"), ("", "empty name of a language"), ("fr", "w " * 50_000), ("fr", "v" * 300_000), ("de", "\n\n .,;:!?\x0b\x0c\r \t")]
    return rows + rows[:3]


@pytest.mark.parametrize("least, longest, top", [(3, 5, 7), (2, 3, 1000), (5, 2, 4)])
def test_phrases(spark, least, longest, top):
    rows = odd_texts()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n int, phrase string").repartition(3)
    found = sorted(tuple(r) for r in collocations.mine_phrases(df, least, longest, top).collect())
    assert found == brute_phrases(rows, least, longest, top)
    assert found


def test_phrases_when_sketches_are_full(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_CELLS", 1 << 15)
    monkeypatch.setattr(collocations, "MOST_CELLS", 1 << 15)
    rnd = random.Random(6)
    rows = [("en", " ".join(f"{rnd.choice('abc')}{min(rnd.randrange(40_000), rnd.randrange(40_000))}" for _ in range(2_000))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.mine_phrases(df, 2, 3, 100_000).collect()) == brute_phrases(rows, 2, 3, 100_000)


def test_phrases_match_sql(spark):
    against_sql(spark, "op12_phrase_collocations", "/root/testdata/sf0.01")


def test_scores_are_exact_beyond_64_bits(spark):
    n = 8_000_000_000_000_003
    rows = [("en", 0, "", n), ("en", 1, "p", n - 5), ("en", 1, "q", 3_000_000_000_000_001), ("en", 2, "p q", 2_999_999_999_999_999)]
    row = collocations.score_phrases(spark.createDataFrame(rows, "lang string, length int, phrase string, a long")).first()
    assert row["score"] == 1000 * 2_999_999_999_999_999 * n // ((n - 5) * 3_000_000_000_000_001)


# ---- hard negatives ----
def brute_negatives(rows, is_anchor, positives, negatives, low, high):
    clean = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        clean[i] = min(clean.get(i, (label, q)), (label, q), key=lambda r: (r[0], np.array(r[1], "<i4").tobytes()))
    score = lambda a, b: sum(x * y for x, y in zip(clean[a][1], clean[b][1]))
    out = []
    for a in clean:
        if not is_anchor(a):
            continue
        ranked = sorted((-score(a, b), b) for b in clean if b != a)
        own = [r for r in ranked if clean[r[1]][0] == clean[a][0]][:positives]
        for p, positive in own:
            inside = [r for r in ranked if clean[r[1]][0] != clean[a][0] and low * -p <= 100 * -r[0] <= high * -p][:negatives]
            out += [(a, positive, k, n, -p, -s) for k, (s, n) in enumerate(inside, 1)]
    return sorted(out)


def vectors(seed, n, width, labels):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(labels, width))
    return [(int(i), int(i * 7 % labels), [float(np.float32(x)) for x in base[i % 3] + 0.6 * rnd.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("width, labels", [(70, 5), (3, 1), (8, 40)])
def test_negatives(spark, monkeypatch, width, labels):
    monkeypatch.setattr(hardnegatives, "ANCHORS", 3)
    monkeypatch.setattr(hardnegatives, "ROWS", 16)
    rows = vectors(1, 150, width, labels)
    rows += [(None, 1, [1.0] * width), (200, None, [1.0] * width), (201, 1, None), (202, 1, [math.nan] * width), (203, 1, [1.0, None]), (204, 0, [math.inf]), (205, 0, []), (206, 2, [2.0]), rows[10], rows[10], (12, rows[12][1], [0.5] * width), *[(300 + i, 1, rows[5][2]) for i in range(30)], (400, 2, [0.0] * width)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, block int, bucket string").repartition(4)
    found = hardnegatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, positives=4, negatives=3, low=50)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    wanted = brute_negatives(rows, lambda i: i % 10 == 0, 4, 3, 50, 100)
    assert sorted(tuple(r) for r in found.collect()) == wanted
    assert wanted or labels == 1


def test_negatives_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hardnegatives.mine_hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(1, 1, [1.0])], empty.schema)
    assert hardnegatives.mine_hard_negatives(one, F.lit(False)).count() == 0
    assert hardnegatives.mine_hard_negatives(one, F.lit(True)).count() == 0


def test_products_are_exact():
    big = np.full((2, 3), hardnegatives.LARGEST, np.int32)
    assert hardnegatives.product(big, -big).tolist() == [[-3 * hardnegatives.LARGEST**2] * 2] * 2
    assert hardnegatives.product(big[:0], big).shape == (0, 2)


def test_negatives_match_sql(spark):
    against_sql(spark, "op13_hard_negatives", "/root/testdata/sf0.01")


# ---- toxicity ----
BAD = ["blorg", "snarf", "krelt", "Wopzé", "drizt"]


def corpus(seed=2, n=900):
    """Two invented languages, unlike in both classes; one word in 25 of a toxic text is bad; some labels are wrong."""
    rnd = random.Random(seed)
    tongues = [["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(400)] for letters in ("abcdefgh", "mnopqrst")]
    rows, labels, truth = [], [], {}
    for i in range(n):
        toxic = i % 6 == 0
        tongue = tongues[rnd.random() < (0.7 if toxic else 0.3)]
        words = [tongue[min(rnd.randrange(400), rnd.randrange(400))] for _ in range(rnd.randint(60, 400))]
        if toxic:
            for k in range(0, len(words), 25):
                words[k] = rnd.choice(BAD)
        rows.append((i, " ".join(words), "xx", "s"))
        truth[i] = int(toxic)
        if i % 10 < 7:
            labels.append((i, None, int(toxic) if rnd.random() > 0.02 else 1 - int(toxic)))
    return rows, labels, truth


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity(spark):
    rows, labels, truth = corpus()
    extra = [(1001, None, None, None), (1002, "", None, None), (1003, "... \n", None, None), (1004, " ".join([r[1] for r in rows if truth[r[0]]] * 10), None, None), (1005, "BLORG! wopzé, snarf — krelt… drizt " * 20, None, None), (1006, " ".join(r[1] for r in rows if not truth[r[0]]), None, None), (None, rows[0][1], None, None), rows[6], rows[6]]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows + extra], "doc_id long, text string, lang string, source string, toxic int, fold double").repartition(4)
    known = spark.createDataFrame([*labels, (None, 1, 1), (2, 1, None), (7777, 1, 1), (1, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(df, known).collect()
    assert len(found) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is not None and is_held_out(r["doc_id"])) for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert [by_id[i]["predicted"] for i in (1001, 1002, 1003, 1004, 1005, 1006)] == [0, 0, 0, 1, 1, 0]
    unseen = [i for i in truth if is_held_out(i) or i % 10 >= 7]
    assert sum(by_id[i]["predicted"] == truth[i] for i in unseen) >= 0.97 * len(unseen)
    assert by_id[None]["score"] == by_id[0]["score"]
    assert len({r["score"] for r in found if r["doc_id"] == 6}) == 1
    # neither the language nor held-out labels change a score
    other = df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.col("text"))
    turned = known.withColumn("toxic", F.when(toxicity.held_out_rows(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(other, turned).collect()}
    assert all(again[i] == pytest.approx(r["score"], abs=1e-12) for i, r in by_id.items())


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1)], none.schema), spark.createDataFrame([(1, 0), (2, 0)], none.schema)):
        assert [r["score"] for r in toxicity.score_toxicity(df, labels).collect()] == [0.0, 0.0]
    assert toxicity.score_toxicity(df.limit(0), none).count() == 0


def test_model_by_hand(spark):
    """The ratios of the model from plain counts of histories and documents."""
    rows, labels, _ = corpus(3, 240)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, toxic int"), toxicity.held_out_rows())
    text, toxic = {r[0]: r[1].lower().split() for r in rows}, {i: t for i, _, t in labels if not is_held_out(i)}
    histories = {c: {(a, b) for i, t in toxic.items() if t == c for a, b in zip(["", *text[i]], text[i])} for c in (0, 1)}
    counts = {c: Counter(b for _, b in pairs) for c, pairs in histories.items()}
    in_rows = Counter(w for ws in text.values() for w in set(ws))
    backoff = sum(map(len, counts.values())) / sum(map(len, histories.values()))
    mass = {c: sum(k - 1 for k in counts[c].values()) for c in counts}
    wanted = []
    for w in {w for c in counts for w, k in counts[c].items() if k > 1}:
        p = {c: (1 - backoff) * max(counts[c][w] - 1, 0) / mass[c] + backoff * in_rows[w] / sum(in_rows.values()) for c in counts}
        wanted.append(math.log(1 - toxicity.SHARE + toxicity.SHARE * p[1] / p[0]))
    assert sorted(model.ratios.tolist()) == pytest.approx(sorted(wanted), rel=1e-9)
