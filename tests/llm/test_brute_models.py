"""The learned operators' results on whole texts against plain Python: verdicts of rules, and kernel ridge scores in the dual form."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import language, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sample(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, df.collect()


def plain_features(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 5))
    n = max(len(words), 1)
    rates = {"n_words": len(words), "word_length": sum(map(len, words)) / n, "symbol_rate": sum(c in "#*$%&|<>" for c in text) / n, "dup_line_rate": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeat_rate": len(inside) / n}
    return rates, len(words) < 10 or 100 * len(inside) > 20 * len(words)


def first_rule(rules, rates):
    for n, rule in enumerate(rules, 1):
        if all((rates[t.feature] >= t.threshold) == t.above for t in rule):
            return n
    return 0


def test_verdicts_of_learned_rules(spark, sample):
    df, rows = sample
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    features = {d: plain_features(t) for d, t in texts.items()}
    # junk that the base limits let through, so that there is a rule to learn
    bad = {d for d, (rates, failed) in features.items() if not failed and rates["n_words"] >= 100}
    labels = spark.createDataFrame([(d, int(d not in bad), 0) for d in texts], "doc_id long, quality int, toxic int")
    cells = quality.labelled_counts(quality.text_statistics(df), labels)
    counted = Counter()
    for d, (rates, _) in features.items():
        bins = tuple(sum(rates[f] >= t for t in grid) for f, grid in quality.GRID.items())
        counted[*bins, d in bad, zlib.crc32(str(d).encode()) % 3 == 0] += 1
    assert {(*[c[f] for f in quality.GRID], c["bad"], c["prune"]): c["n"] for c in cells} == dict(counted)
    rules = quality.learn_rules(cells)
    assert rules and not any(t.feature not in quality.GRID for rule in rules for t in rule)
    found = {r["doc_id"]: (r["base_failed"], r["kept"], r["rule"]) for r in quality.quality_rules(df, labels).collect()}
    wanted = {}
    for d, (rates, failed) in features.items():
        rule = first_rule(rules, rates)
        wanted[d] = (failed, not failed and rule == 0, 0 if failed else rule)
    assert found == wanted
    assert any(rule for _, _, rule in found.values()) and any(kept for _, kept, _ in found.values())


def plain_ngrams(text):
    data = bytes(ord(" ") if 48 <= b <= 57 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in text.encode())
    out = set()
    for k, n in enumerate(language.LENGTHS):
        for i in range(len(data) - n + 1):
            gram = int.from_bytes(data[i : i + n])
            out.add((gram if n == 2 else (gram * 2654435761 % 2**32) >> 16) + k * 65536)
    return out


def kernel(a, b):
    return np.array([[len(x & y) / max(1, len(x) * len(y)) ** 0.5 for y in b] for x in a])


def test_scores_of_languages(spark, sample):
    df, rows = sample
    train = [r for r in rows if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    # as many landmarks as rows, so that the Nyström map is whole and the dual form gives the same scores
    assert len(train) <= language.LANDMARKS
    names = sorted({r["lang"] for r in train})
    sets = [plain_ngrams(r["text"]) for r in train]
    target = np.array([[r["lang"] == n for n in names] for r in train], float)
    weight = 1 / target.sum(0)[target.argmax(1)]
    share = weight / weight.sum()
    gram = kernel(sets, sets)
    row_mean = gram @ share
    centred = gram - row_mean[:, None] - row_mean[None, :] + share @ gram @ share
    base = share @ target
    dual = np.linalg.solve(centred + language.RIDGE * np.diag(1 / weight), target - base)
    asked = [r for r in rows if r["text"] is not None and any(map(str.isalpha, r["text"]))]
    near = kernel([plain_ngrams(r["text"]) for r in asked], sets)
    scores = base + (near - (near @ share)[:, None] - row_mean[None, :] + share @ gram @ share) @ dual
    found = {r["doc_id"]: r for r in language.identify_languages(df).collect()}
    assert len(found) == len(rows)
    for r, line in zip(asked, scores):
        own = found[r["doc_id"]]
        assert own["score"] == pytest.approx(min(1, max(0, line.max())), abs=2e-3)
        if np.sort(line)[-1] - np.sort(line)[-2] > 4e-3:
            assert own["lang_pred"] == names[int(line.argmax())]
    for r in rows:
        if r not in asked:
            assert (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) == ("und", 0)
