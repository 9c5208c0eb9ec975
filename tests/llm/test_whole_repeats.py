"""A passage in the overlap of two pieces of a long text, met again later in the same partition."""

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import repeats

PIECE = 1000


def brute(texts):
    count = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    out = set()
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out |= {(b, i) for i, g in enumerate(gone) if g}
    return out


@pytest.mark.parametrize("shift", [1, 20, 40])
def test_passage_over_a_piece_boundary(monkeypatch, shift):
    monkeypatch.setattr(repeats, "PIECE_BYTES", PIECE)
    rnd = random.Random(shift)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    # one seed, and so two anchors, stand for the whole passage, with equal surroundings on both sides
    place = []
    while list(place) != [80, 160]:
        passage = word(360)
        place = repeats.anchors(np.frombuffer(passage.encode(), np.uint8), np.array([0, 360]))[0]
    at = 2 * PIECE + shift - 160
    texts = [(word(at) + passage + word(3 * PIECE)).encode(), (word(300) + passage + word(300)).encode()]
    flags = SimpleNamespace(value=b"\xff" * (repeats.FILTER_BITS // 8))
    rows = pa.Table.from_batches(repeats._contexts(flags)(iter([pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts])], ["text"])])))
    places = list(zip(rows["text_id"].to_pylist(), rows["place"].to_pylist()))
    assert len(places) == len(set(places))
    side = pa.array(np.full(len(places), repeats.SIDE), pa.int32())
    rows = rows.append_column("low", pa.array(np.zeros(len(places), np.int32))).append_column("high", side).sort_by("key").combine_chunks()
    own = {hashlib.md5(t, usedforsecurity=False).digest(): t for t in texts}
    found = {(own[r["text_id"]], i) for b in repeats._compare(iter(rows.to_batches())) for r in b.to_pylist() for i in range(r["a"], r["b"])}
    assert found == brute(texts)


def test_multikey_quicksort():
    rnd = np.random.default_rng(4)
    group, words = rnd.integers(0, 5, 400), rnd.integers(0, 4, (400, 2)).astype(np.uint64)
    order, first = repeats.multikey_quicksort(group, words)
    rows = [(group[i], *words[i]) for i in order]
    assert rows == sorted(rows) and sorted(order) == list(range(400))
    assert all(first[i] == rows.index(r) for i, r in enumerate(rows))


def test_hot_seeds_and_a_very_long_text(spark, monkeypatch):
    """A passage in many texts at many depths, its edges, and a text of several pieces against a fast brute force."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(900)
    texts = [word(rnd.randint(0, 90)) + passage[rnd.randint(0, 500) :][: rnd.randint(150, 600)] + word(rnd.randint(0, 90)) for _ in range(60)]
    texts += [word(700_000) + passage + word(60_000), word(250) + passage[:230], texts[0]]
    count = Counter(hash(b[i : i + 200]) for b in map(str.encode, texts) for i in range(len(b) - 199))
    wanted = []
    for n, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[hash(t.encode()[i : i + 200] if len(t) < 9999 else t[i : i + 200].encode())] > 1:
                gone[i : i + 200] = b"\1" * 200
        wanted.append((n, len(t), sum(gone), hashlib.sha256(bytes(x for x, g in zip(t.encode(), gone) if not g)).hexdigest()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for rows in (6_000, 4):
        monkeypatch.setattr(repeats, "CELL_ROWS", rows)
        found = repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, found)) == wanted
