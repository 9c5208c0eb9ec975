"""Operator 10, language identification: a blended-spectrum kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bytewise import slices, utf8

#: Byte n-grams of these lengths are features: pairs by themselves, longer ones by a hash of as many values.
LENGTHS = (2, 3, 4)
SPACE = 1 << 16
FEATURES = SPACE * len(LENGTHS)
#: Labelled documents that are fitted on: for each language at most, and in all (but LEAST_ROWS for each language).
FIT_ROWS, ALL_ROWS, LEAST_ROWS = 200, 12_800, 2
#: Landmarks at least; with more languages, LEAST_ROWS for each.
LANDMARKS, RIDGE = 160, 1e-3
#: Up to so many languages weights are kept for each feature; beyond, for each landmark.
DENSE = 64
UNKNOWN = "und"
#: A text is in a language if so much of what nearly all labelled texts share with the others of theirs, it shares too:
#: this times the percentile of their shares. Up to PERCENTILE of the labelled texts may be junk.
FAMILIAR, PERCENTILE = 0.7, 5


def ngram_ids(data: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of a text's bytes, for each length."""
    wide = data.astype(np.uint32)
    gram = wide
    for k, n in enumerate(LENGTHS):
        if len(data) < n:
            return
        while len(gram) > len(data) - n + 1:
            gram = gram[:-1] * np.uint32(256) + wide[len(data) - len(gram) + 1 :]
        yield (gram if n == 2 else (gram * np.uint32(2654435761)) >> np.uint32(16)) + np.uint32(k * SPACE)


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII capitals as small letters, digits and white space as a space."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 32
_LOWER[9:14] = 32


def present(data: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Feature numbers that a text has, sorted; ``flags`` is a work array of FEATURES zeros and is left so."""
    for ids in ngram_ids(lowered(data)):
        flags[ids] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """``scores = presence @ weights / sqrt(number of features of the text) + offsets``, one column per language.

    With many languages ``weights`` has a row for each landmark instead of each feature, and ``marks`` the landmarks
    that have a feature: those of feature f are ``marks[1][marks[0][f] : marks[0][f + 1]]``.
    ``seen``: packed presence of FEATURES in any fitted row of each language. ``floors``: the least share of a text's
    features that must be among them. Neither depends on the other languages.
    """

    languages: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    seen: np.ndarray
    floors: np.ndarray
    marks: tuple[np.ndarray, np.ndarray] | None = None

    def familiar(self, features: np.ndarray, language: int) -> bool:
        """Whether the text of these features looks like the language's fitted rows."""
        share = (self.seen[language, features >> 3] >> (7 - (features & 7)) & 1).mean() if len(features) else 0.0
        return bool(share >= self.floors[language])

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """A product of the sparse presence matrix of a batch of texts with the weights."""
        sizes = np.array([len(s) for s in sets])
        out = np.zeros((len(sets), len(self.languages)))
        if self.marks is not None:
            shared = np.array([self._shared(s) for s in sets]).reshape(len(sets), len(self.weights))
            return shared @ self.weights / np.sqrt(np.maximum(sizes, 1))[:, None] + self.offsets
        if sizes.sum():
            full = np.flatnonzero(sizes)
            heads = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            out[full] = np.add.reduceat(self.weights[np.concatenate([sets[i] for i in full])], heads, axis=0) / np.sqrt(sizes[full])[:, None]
        return out + self.offsets

    def _shared(self, features: np.ndarray) -> np.ndarray:
        """How many features a text has in common with each landmark."""
        heads, rows = self.marks
        number = heads[features + 1] - heads[features]
        at = np.repeat(heads[features] - np.cumsum(number) + number, number) + np.arange(number.sum())
        return np.bincount(rows[at], minlength=len(self.weights))


def familiarity(bits: np.ndarray) -> tuple[np.ndarray, float]:
    """Packed features of any row, and the floor of one language, from its rows.

    Each distinct row is held back in turn: its share is that of its features which another row has. One row alone
    gives a floor of 0, which rejects nothing.
    """
    rows = np.unpackbits(np.unique(bits, axis=0), axis=1)
    count = rows.sum(0, dtype=np.int32)
    share = (rows & (count > 1)).sum(1) / np.maximum(rows.sum(1, dtype=np.int32), 1)
    return np.packbits(count > 0), FAMILIAR * float(np.percentile(share, PERCENTILE))


def fit(bits: np.ndarray, labels: list[str]) -> Model:
    """Kernel ridge regression on the landmarks' features, one language against the rest.

    ``bits``: packed presence of FEATURES for each row. The kernel of two texts is the number of n-grams that both have,
    over the root of the product of their numbers. Landmarks are rows spread evenly over the languages.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), np.zeros((0, FEATURES // 8), np.uint8), np.zeros(0))
    turn: dict[str, int] = {}
    rank = [turn.update({x: turn.get(x, -1) + 1}) or turn[x] for x in labels]
    marks = np.argsort(rank, kind="stable")[: max(LANDMARKS, LEAST_ROWS * len(languages))]
    shared = np.zeros((len(labels), len(marks)))
    size = np.zeros(len(labels))
    # so that a block of all rows takes 64 MB at most
    step = max(1, min(bits.shape[1] // 24, (1 << 21) // len(labels)))
    for a in range(0, bits.shape[1], step):
        block = np.unpackbits(bits[:, a : a + step], axis=1).astype(np.float32)
        shared += block @ block[marks].T
        size += block.sum(1)
    root = np.sqrt(np.maximum(size, 1))
    kernel = shared / root[:, None] / root[marks]
    value, vector = np.linalg.eigh(kernel[marks])
    keep = value > 1e-8 * value.max()
    lift = vector[:, keep] / np.sqrt(value[keep])
    mapped = kernel @ lift
    target = (np.array(labels)[:, None] == np.array(languages)[None, :]).astype(float)
    # rows weigh so that each language counts alike
    weight = 1 / target.sum(0)[target.argmax(1)]
    mean = (weight[:, None] * mapped).sum(0) / weight.sum()
    base = (weight[:, None] * target).sum(0) / weight.sum()
    centred = mapped - mean
    beta = np.linalg.solve(centred.T @ (weight[:, None] * centred) + RIDGE * np.eye(centred.shape[1]), centred.T @ (weight[:, None] * (target - base)))
    by_mark = (lift @ beta) / root[marks][:, None]
    seen, floors = zip(*(familiarity(bits[np.array(labels) == x]) for x in languages))
    if len(languages) > DENSE:
        rows, features = np.concatenate([np.stack((np.full(len(f), i), f)).astype(np.int32) for i, m in enumerate(marks) for f in [np.flatnonzero(np.unpackbits(bits[m]))]], axis=1)
        heads = np.concatenate(([0], np.cumsum(np.bincount(features, minlength=FEATURES))))
        return Model(languages, by_mark.astype(np.float32), base - mean @ beta, np.array(seen), np.array(floors), (heads, rows[np.argsort(features, kind="stable")]))
    weights = np.zeros((FEATURES, len(languages)), np.float32)
    for a in range(0, bits.shape[1], step):
        weights[8 * a : 8 * (a + step)] = np.unpackbits(bits[marks, a : a + step], axis=1).astype(np.float32).T @ by_mark.astype(np.float32)
    return Model(languages, weights, base - mean @ beta, np.array(seen), np.array(floors))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = np.zeros(FEATURES, bool)
    for batch in batches:
        data, starts = utf8(batch.column(1))
        rows = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            line = np.zeros(FEATURES, bool)
            line[present(data[a:b], flags)] = True
            rows.append(np.packbits(line).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "bits"])


def fit_languages(docs: DataFrame, held_out, rows_each: int = FIT_ROWS, rows: int = ALL_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows outside ``held_out``.

    Every language is fitted. The bound: ``rows`` rows shared evenly, with ``LEAST_ROWS`` to ``rows_each`` for each
    language, those with the smallest hashes of id and text, repeated rows once; each comes to the driver as FEATURES bits.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    labelled = labelled.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    rows_each = max(LEAST_ROWS, min(rows_each, rows // max(1, labelled.select("lang").distinct().count())))
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    chosen = labelled.select("lang", "h").withColumn("rank", rank).where(F.col("rank") <= rows_each).select("lang", "h").distinct().collect()
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "lang string, h long")
    sample = labelled.join(F.broadcast(wanted), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    found = sample.select("lang", "text").mapInArrow(_bitmaps, "lang string, bits binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    bits = np.array([np.frombuffer(r["bits"], np.uint8) for r in found]).reshape(len(found), FEATURES // 8)
    return fit(bits, [r["lang"] for r in found])


def predict(model: Model, column: pa.Array, together: int = 256) -> tuple[list[str], list[float], list[bool]]:
    """Language and score of each text of a column, and whether it looks like that language; ``together`` at a time."""
    flags = np.zeros(FEATURES, bool)
    data, starts = utf8(column)
    known: list[str] = []
    score: list[float] = []
    familiar: list[bool] = []
    for a in range(0, len(column), together):
        rows = [data[starts[i] : starts[i + 1]] for i in range(a, min(a + together, len(column)))]
        letters = [bool(model.languages) and has_letter(bytes(text).decode("utf-8", "replace")) for text in rows]
        sets = [present(text, flags) if yes else np.zeros(0, int) for text, yes in zip(rows, letters)]
        for line, own, yes in zip(model.scores(sets), sets, letters):
            best = int(line.argmax()) if yes else -1
            known.append(model.languages[best] if yes else UNKNOWN)
            score.append(float(min(1.0, max(0.0, line[best]))) if yes else 0.0)
            familiar.append(yes and model.familiar(own, best))
    return known, score, familiar


def held_out_rows():
    """The rows that nothing is learned from: the CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from the bytes of its whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no row is labelled. Rows without
    id or language are predicted but not learned from. Repeated rows are each predicted. An empty table gives an empty
    result. Other columns of ``docs`` are ignored.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = fit_languages(docs, held_out_rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known, score, _ = predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out_rows().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that look like the learned language that they are found to be in.

    The scores of a text add up to 1 over the languages, so the best one says little of a text in none of them. A text
    stays if the share of its n-grams that the language's fitted rows have reaches the language's floor
    (``familiarity``). A missing ``lang`` becomes the language found.

    Null and empty texts and texts without a letter go, as does everything if no row is labelled. Rows without id stay
    if their text does; repeated rows are each judged alike. An empty table gives an empty result. Other columns stay.
    """
    model = fit_languages(docs, held_out_rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known, _, familiar = predict(model, batch.column("text"))
            lang = [old or new for old, new in zip(batch.column("lang").to_pylist(), known)]
            kept = pa.array(familiar, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()) if n == "lang" else batch.column(n) for n in batch.schema.names], batch.schema.names).filter(kept)

    return docs.mapInArrow(run, docs.schema)
