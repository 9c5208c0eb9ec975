"""Operator 11, toxicity: class-conditional Kneser-Ney word models over shared backoff counts, compared per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bytewise import chunks, mix, string_hashes, utf8
from ledgerloom.llm.staging import stage

#: Labelled rows of each class that are learned from, about; and parts of the text that are counted together.
TOXIC_ROWS, ORDINARY_ROWS, TOGETHER = 6_000, 24_000, 4 << 20
#: Share of a toxic text's words that come from the toxic model; the rest is like ordinary text.
SHARE = 0.003
#: An expression with one history only says nothing of its class: that much goes to the shared counts.
DISCOUNT = 1.0
#: Words of the model in one block of document counts.
BLOCK = 8192
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of whole rows: first row, number of rows, distinct word hashes, and for each word its index there and row.

    Words are runs of ASCII letters and digits and of other characters beyond ASCII but general punctuation, lower case.
    """
    data, starts = utf8(pc.utf8_lower(column))
    for first_row, part, at in chunks(data, starts, TOGETHER):
        inside = _LETTER[part]
        if len(part) > 2:
            marks = np.flatnonzero((part[:-2] == 0xE2) & ((part[1:-1] == 0x80) | (part[1:-1] == 0x81)))
            for k in range(3):
                inside[marks + k] = False
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        heads = at[:-1][at[:-1] < len(part)]
        fresh[heads] = inside[heads]
        first = np.flatnonzero(fresh)
        offsets = np.append(np.cumsum(inside, dtype=np.int64)[first] - 1, np.count_nonzero(inside)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part[inside]))).dictionary_encode()
        if len(first):
            _, of_word, letters = words.dictionary.buffers()
            hashes = string_hashes(np.frombuffer(letters, np.uint8), np.frombuffer(of_word, np.int32)[: len(words.dictionary) + 1].astype(np.int64))
        else:
            hashes = np.zeros(0, np.uint64)
        yield first_row, len(at) - 1, hashes, words.indices.to_numpy().astype(np.int64), np.searchsorted(at, first, "right") - 1


def _histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with the word before them, by class and fold."""
    for batch in batches:
        kinds = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column("fold").to_numpy()
        for first, _, hashes, word, row in words_of(batch.column("text")):
            if not len(word):
                continue
            before = np.where(np.diff(row, prepend=-1) > 0, np.uint64(0), hashes[np.concatenate(([0], word[:-1]))])
            kind = kinds[first + row]
            pair = mix(before * _BASE + np.uint64(1)) ^ hashes[word]
            own = np.unique(np.rec.fromarrays([kind, word, pair]))
            yield pa.RecordBatch.from_arrays([pa.array(own.f0 // 2, pa.int32()), pa.array(1 + own.f0 % 2, pa.int32()), pa.array(hashes[own.f1].view(np.int64)), pa.array(own.f2.view(np.int64))], ["toxic", "fold", "word", "history"])


def continuation_counts(sample: DataFrame) -> DataFrame:
    """word, and the number of different words before it in toxic and ordinary rows, of fold 1, of fold 2 and of both.

    Copies of a text add nothing, as their words have the same histories.
    """
    pairs = sample.select("text", "toxic", "fold").mapInArrow(_histories, "toxic int, fold int, word long, history long")
    pairs = pairs.groupBy("toxic", "word", "history").agg(F.bit_or("fold").alias("folds"))
    count = lambda toxic, fold: F.sum(((F.col("toxic") == toxic) & (F.col("folds").bitwiseAND(fold) != 0)).cast("long"))
    return pairs.groupBy("word").agg(*[count(t, f).alias(f"{name}{f}") for t, name in ((1, "toxic"), (0, "ordinary")) for f in (1, 2, 3)])


def _documents(vocabulary):
    """How many of a task's rows have each word of the vocabulary, in blocks; the entry after the last: any word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        counts = np.zeros(-(-(len(known) + 1) // BLOCK) * BLOCK, np.int64)
        for batch in batches:
            for _, rows, hashes, word, row in words_of(batch.column(0)):
                if len(word):
                    pairs = pa.array(word * rows + row).unique().to_numpy() // rows
                    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                    at = np.where(known[at] == hashes, at, len(known)) if len(known) else np.zeros(len(hashes), int)
                    counts += np.bincount(at[pairs], minlength=len(counts))
                    counts[len(known)] += len(pairs) - np.count_nonzero(at[pairs] == len(known))
            pa.default_memory_pool().release_unused()
        full = [k for k in range(len(counts) // BLOCK) if counts[k * BLOCK : (k + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([counts[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in full], pa.binary())], ["block", "counts"])

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(c.as_py(), np.int64) for c in table.column("counts")), np.zeros(BLOCK, np.int64))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def document_counts(docs: DataFrame, words: np.ndarray, tasks: int = 4096) -> tuple[np.ndarray, int]:
    """For each of the sorted ``words`` how many rows of ``docs`` have it, and the sum of that over all words there are."""
    known = docs.sparkSession.sparkContext.broadcast(words)
    blocks = docs.select(F.coalesce("text", F.lit("")).alias("text")).coalesce(tasks).mapInArrow(_documents(known), "block int, counts binary")
    counts = np.zeros(-(-(len(words) + 1) // BLOCK) * BLOCK, np.int64)
    for r in blocks.groupBy("block").applyInArrow(_added, "block int, counts binary").collect():
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
    return counts[: len(words)], int(counts[len(words)])


def log_ratios(toxic: np.ndarray, ordinary: np.ndarray, shared: np.ndarray, backoff: float, share: float = SHARE) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of each word.

    A class has what its discounted continuation counts give, and ``backoff`` of its mass from the probabilities that
    both share; a toxic text takes ``share`` of its words from the toxic model, the rest from the ordinary one.
    """
    own = [np.maximum(c - DISCOUNT, 0) for c in (toxic, ordinary)]
    of_class = [(1 - backoff) * c / max(1.0, c.sum()) + backoff * shared for c in own]
    return np.log(1 - share + share * of_class[0] / of_class[1])


@dataclass
class Model:
    """Sorted word hashes with their log ratios (0 for other words), and what turns a mean into a probability."""

    words: np.ndarray
    ratios: np.ndarray
    scale: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def means(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The mean log ratio of the words of each text, and how many words it has."""
        total, number = np.zeros(len(column)), np.zeros(len(column), np.int64)
        for first, rows, hashes, word, row in words_of(column):
            if len(word) and len(self.words):
                at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
                ratio = np.where(self.words[at] == hashes, self.ratios[at], 0.0)
                total[first : first + rows] = np.bincount(row, ratio[word], rows)
            number[first : first + rows] = np.bincount(row, minlength=rows)
        return total / np.maximum(number, 1), number

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.bent(means) + self.offset, -500, 500)))

    def bent(self, means: np.ndarray) -> np.ndarray:
        return np.sign(means) * np.log1p(np.abs(means) / self.scale)


def calibrate(model: Model, means: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
    """Logistic regression of the class on the bent mean, by Newton's steps with a small ridge."""
    model.scale = float(np.median(np.abs(means[~toxic]))) or 1e-3
    x = np.stack((model.bent(means), np.ones(len(means))), 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        gradient = x.T @ (weight * (toxic - p)) - 1e-3 * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = max(0.0, float(beta[0])), float(beta[1])


def labelled_rows(docs: DataFrame, labels: DataFrame, held_out: Column, toxic_rows: int, ordinary_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """text, toxic and fold of about so many rows of each class outside ``held_out``, and the classes' sizes in all.

    Labels of one document are averaged. Rows go in by a hash of their id, so no class or source is left out.
    """
    votes = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    votes = votes.where(~held_out)
    sizes = {r["toxic"]: r["n"] for r in votes.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # of 2**30 places of a hash, those that a class of that size takes
    limit = {c: (most << 30) // max(1, sizes.get(c, 0)) for c, most in ((1, toxic_rows), (0, ordinary_rows))}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = votes.where(place < F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0])).select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("fold"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold"), sizes


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model | None:
    """Learn from about ``toxic_rows`` and ``ordinary_rows`` labelled rows, and from the document counts of all of ``docs``.

    The driver gets the words that have two histories or more in a class, at most half the words of those rows. The
    scores that are turned into probabilities come from models of the other half of the rows. None: a class has no rows.
    """
    sample, sizes = labelled_rows(docs, labels, held_out, toxic_rows, ordinary_rows)
    if len(sizes) < 2:
        return None
    sample = stage(sample, "toxicity-sample")
    counts = stage(continuation_counts(sample), "toxicity-counts")
    total = counts.agg(F.sum((F.col("toxic3") > 0).cast("long") + (F.col("ordinary3") > 0).cast("long")).alias("types"), F.sum(F.col("toxic3") + F.col("ordinary3")).alias("all")).first()
    found = counts.where("toxic3 > 1 or ordinary3 > 1").toArrow()
    hashes = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    words, of = hashes[order], {c: found.column(c).to_numpy()[order] for c in found.column_names if c != "word"}
    rows, every = document_counts(docs, words)
    shared = np.maximum(rows, 1) / max(1, every)
    backoff = DISCOUNT * (total["types"] or 0) / max(1, total["all"] or 0)
    models = {f: Model(words, log_ratios(of[f"toxic{f}"], of[f"ordinary{f}"], shared, backoff)) for f in (1, 2, 3)}
    halves = docs.sparkSession.sparkContext.broadcast({f: models[f] for f in (1, 2)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = {f: m.means(batch.column("text")) for f, m in halves.value.items()}
            # rows of fold 0 are in models of fold 1 by number, so they are judged by the other
            other = np.where(batch.column("fold").to_numpy() == 0, means[2][0], means[1][0])
            has_words = means[1][1] > 0
            yield pa.RecordBatch.from_arrays([pa.array(other[has_words]), batch.column("toxic").filter(pa.array(has_words))], ["mean", "toxic"])

    judged = sample.mapInArrow(run, "mean double, toxic int").toArrow()
    toxic = judged.column("toxic").to_numpy() == 1
    if toxic.all() or not toxic.any():
        return None
    weight = np.where(toxic, sizes[1] / toxic.sum(), sizes[0] / (~toxic).sum()) * len(toxic) / (sizes[0] + sizes[1])
    calibrate(models[3], judged.column("mean").to_numpy(), toxic, weight)
    return models[3]


def held_out_rows() -> Column:
    """The rows whose labels nothing is learned from: the CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every row, from its whole text.

    The score is the probability that goes with the mean log-likelihood ratio of a text's words under the toxic and the
    ordinary model. Null and empty texts and texts without a word have score 0, as has everything if a class has no
    labelled row. Labels may be missing, null or repeated (averaged); rows without id are scored. Repeated rows are each
    scored alike. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    model = fit(docs, labels, held_out_rows())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if shared.value:
                means, number = shared.value.means(batch.column("text"))
                score = np.where(number > 0, shared.value.probabilities(means), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", held_out_rows().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
