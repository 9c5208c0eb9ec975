"""Operator 5, packing: harmonic classes of reciprocal capacity, each bin with a fixed number of pieces."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.staging import stage

#: Pieces of at least this length have a power of two as theirs, so that their bins have no padding.
LEAST_PIECE = 32
#: Ranges of documents whose pieces are numbered by themselves.
RANGES = 512
#: Distinct words whose ids a Python worker keeps; beyond it, words are encoded again each time.
KEPT_WORDS = 200_000

_SPLIT_WRONG = re.compile(r"\s (?:\s|\Z)")


class _Words(dict):
    """Ids of a space and a word as bytes; what is asked for first is encoded then."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(self) < KEPT_WORDS:
            self[word] = ids
        return ids


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers, from a vocabulary file of byte BPE ranks.

    A space before a character that isn't white space always begins a pre-token, so text is cut there and the ids of
    words that come again are looked up. Texts with longer runs of white space are encoded at once.

    ``added``: tokens that stand for themselves wherever a text has them, with their ids; the text between is encoded by
    itself. By default those of ``byte_bpe_50k.json``, which tokenizers finds too if no special tokens are to be added.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, added: dict[str, int] | None = None):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = _Words(self.whole)
        added = added_tokens(public_tokenizers.path("byte_bpe_50k.json")) if added is None else added
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        # of two tokens at one place the longer
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self.between(text)
        out, at = b"", 0
        for m in self.cut.finditer(text):
            out += self.between(text[at : m.start()]) + self.added[m[0]]
            at = m.end()
        return out + self.between(text[at:])

    def between(self, text: str) -> bytes:
        if _SPLIT_WRONG.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.words.__getitem__, rest))


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a vocabulary file of tokenizers adds to its ranks, with their ids."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def cut(length: int, capacity: int, least: int = LEAST_PIECE) -> list[int]:
    """Lengths of a document's pieces: full sequences, then falling powers of two from half of it, then what is left."""
    pieces = [capacity] * (length // capacity)
    left, size = length % capacity, capacity // 2
    while size >= least:
        if left >= size:
            pieces.append(size)
            left -= size
        size //= 2
    return pieces + [left] * (left > 0)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                total, start = len(ids) // 4, 0
                for length in cut(total, capacity):
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total))
                    start += length
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return run


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Cut every document's ids, ended by ``end_id``, into pieces and put these into sequences of ``capacity`` tokens.

    Class k holds the pieces whose length is in (capacity / (k + 1), capacity / k]; every bin of it takes k pieces. As
    pieces are cut to powers of two from ``LEAST_PIECE`` on, only bins of shorter pieces have padding, below one piece.
    Pieces are numbered within ranges of documents, and a table of counts by range and length turns this into numbers of
    the whole class: no task sees a whole class. A class's last bin is cut into powers of two, or joins the other last
    bins of short pieces (at most capacity * ln(LEAST_PIECE) tokens in all) in shared sequences.

    Null and empty texts are one piece with the end id. Repeated rows are packed each. Null ids are packed like others.
    An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    if capacity & (capacity - 1) or capacity < 2 * LEAST_PIECE:
        raise ValueError(f"capacity must be a power of two from {2 * LEAST_PIECE} on")
    step = capacity + 2048
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = stage(pieces.withColumn("range", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANGES)).cast("int")), "pack-pieces")
    counts = pieces.groupBy("length", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("length")).alias("total"))
    own = F.row_number().over(Window.partitionBy("length", "range").orderBy("doc_id", "start", "ids_crc32")) - 1
    held = F.floor(capacity / F.col("length")).cast("long")
    numbered = pieces.withColumn("own", own).join(bases, ["length", "range"]).withColumns({"number": F.col("base") + F.col("own"), "held": held})
    left = F.col("total") % F.col("held")
    numbered = numbered.withColumns({"left": left, "place": F.col("number") - (F.col("total") - left)})
    shared = _shared_sequences(counts, capacity)
    rows = numbered.join(F.broadcast(shared), ["length", "place"], "left")
    # of a last bin of powers of two: the highest binary digit in which a piece's place differs from the number of pieces
    digit = F.length(F.bin(F.col("place").bitwiseXOR(F.col("left")))) - 1
    first = F.col("place") - F.col("place") % F.call_function("shiftleft", F.lit(1).cast("long"), digit)
    sequence = F.when(F.col("place") < 0, F.floor(F.col("number") / F.col("held")) * step + F.col("length")).when(F.col("bin").isNotNull(), F.col("bin") * step + (capacity + 2000)).otherwise(32 * (F.length(F.bin("length")) - 1) + digit + (capacity + 1))
    offset = F.when(F.col("place") < 0, F.col("number") % F.col("held") * F.col("length")).when(F.col("bin").isNotNull(), F.col("tokens_before")).otherwise((F.col("place") - first) * F.col("length"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def _shared_sequences(counts: DataFrame, capacity: int) -> DataFrame:
    """Where the pieces of the last bins of lengths that are no power of two go: length, place, bin, tokens_before.

    Below ``capacity / length`` pieces for each length under ``LEAST_PIECE``: at most capacity * ln(LEAST_PIECE) rows.
    """
    lengths = counts.where((F.col("length").bitwiseAND(F.col("length") - 1)) != 0).groupBy("length").agg(F.sum("n").alias("total"))
    last = lengths.withColumn("left", F.col("total") % F.floor(capacity / F.col("length"))).where("left > 0")
    places = last.select("length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left") - 1)).alias("place"))
    before = F.coalesce(F.sum("length").over(Window.orderBy("length", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    binned = places.withColumn("before", before).withColumn("bin", F.floor(F.col("before") / (capacity - LEAST_PIECE + 1)).cast("long"))
    return binned.select("length", "place", "bin", (F.col("before") - F.min("before").over(Window.partitionBy("bin"))).alias("tokens_before"))
