"""Operator 12, phrase collocations: merged count-min sketches, an exact count of what they let through, cuts, subsumption."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bytewise import mix, string_hashes, utf8
from ledgerloom.llm.staging import stage

UNKNOWN = "und"
#: Text bytes whose n-grams are counted together before they go to a sketch or to the exact count.
TOGETHER = 4 << 20
#: Rows of a sketch; cells of a block of it; least and most cells of a row, and text bytes for each cell between.
DEPTH, BLOCK, LEAST_CELLS, MOST_CELLS, BYTES_EACH = 2, 1 << 15, 1 << 16, 1 << 26, 256
#: Sketches at most: partitions are joined beyond, so that what is merged doesn't grow without limit.
SKETCHES = 4096
#: Text bytes that a task takes at least, where that leaves one for each core: larger tasks add up more before a shuffle.
TASK_BYTES = 1 << 26
#: Counted n-grams that a task adds up before it hands them over.
HELD = 1_000_000
#: Parts into which a language's phrases fall before its first ones are taken.
PARTS = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: 0: in a word; 1: between words; 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Grams:
    """The distinct n-grams of one length in a part of the texts: counts, hashes, and those of one word fewer."""

    length: int
    counts: np.ndarray
    hashes: np.ndarray
    langs: np.ndarray
    names: Callable[[np.ndarray], pa.Array]


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of lower-cased text, and the number of the piece and of the row of each."""
    kind = _KIND[data]
    inside = kind == 0
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    heads = starts[:-1][starts[:-1] < len(data)]
    fresh[heads] = inside[heads]
    breaks = kind == 2
    breaks[heads] = True
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(np.cumsum(inside, dtype=np.int32)[first] - 1, np.count_nonzero(inside)))
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return words.dictionary_encode(), np.cumsum(breaks, dtype=np.int32)[first], np.searchsorted(starts, first, "right") - 1


def grams(data: np.ndarray, starts: np.ndarray, row_langs: np.ndarray, lang_hashes: np.ndarray, longest: int, passes: Callable[[int, np.ndarray], np.ndarray | None]) -> Iterator[Grams]:
    """Distinct n-grams of 1 to ``longest`` words of a language, shortest first, never across pieces.

    ``passes(length, hashes)`` tells which n-grams may be part of longer ones (None: all); an n-gram is formed of two
    shorter ones that overlap, so it isn't formed if one of these doesn't pass.
    """
    words, piece, row = _words(_LOWER[data], starts)
    if not len(words):
        return
    _, word_starts, letters = words.dictionary.buffers()
    of_word = string_hashes(np.frombuffer(letters, np.uint8), np.frombuffer(word_starts, np.int32)[: len(words.dictionary) + 1].astype(np.int64))
    pair = words.indices.to_numpy().astype(np.int64) * len(lang_hashes) + row_langs[row]
    own = pa.array(pair).dictionary_encode()
    at, kinds = own.indices.to_numpy().astype(np.int64), own.dictionary.to_numpy()
    word, lang = kinds // len(lang_hashes), kinds % len(lang_hashes)
    hashes = one_word = mix(of_word[word] ^ lang_hashes[lang])
    last = np.arange(len(kinds))
    names = lambda found: words.dictionary.take(pa.array(word[found]))
    first_names, place = names, np.arange(len(at))
    for length in range(1, longest + 1):
        yield Grams(length, np.bincount(at, minlength=len(hashes)), hashes, lang, names)
        if length == longest:
            return
        good = passes(length, hashes)
        held = np.full(len(piece) + 1, -1, np.int64)
        keep = np.ones(len(at), bool) if good is None else good[at]
        held[place[keep]] = at[keep]
        both = (held[:-1] >= 0) & (held[1:] >= 0)
        if length == 1:
            both[:-1] &= piece[1:] == piece[:-1]
        place = np.flatnonzero(both)
        if not len(place):
            return
        own = pa.array(held[place] * len(hashes) + held[place + 1]).dictionary_encode()
        at, kinds = own.indices.to_numpy().astype(np.int64), own.dictionary.to_numpy()
        head, tail = kinds // len(hashes), kinds % len(hashes)
        last = last[tail]
        hashes, lang = mix(hashes[head] * _BASE + one_word[last]), lang[head]
        names = lambda found, before=names, head=head, last=last: pc.binary_join_element_wise(before(head[found]), first_names(last[found]), " ")


def _cells(hashes: np.ndarray, width: int, row: int) -> np.ndarray:
    return ((hashes >> np.uint64(32 * row)) & np.uint64(width - 1)).astype(np.int64)


@dataclass
class Sieve:
    """Which cells of merged sketches reach the least count, a bit each; an n-gram passes if all of its cells do."""

    bits: np.ndarray
    width: int

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(DEPTH):
            cells = _cells(hashes, self.width, row)
            out &= (self.bits[row, cells >> 3] >> (7 - (cells & 7)) & 1).astype(bool)
        return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Bytes, row starts and language numbers of parts of whole rows, with the languages."""
    for batch in batches:
        langs = pc.fill_null(batch.column("lang"), UNKNOWN).dictionary_encode()
        data, starts = utf8(batch.column("text"))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(starts, starts[row] + TOGETHER, "right")) - 1)
            yield data[starts[row] : starts[end]], starts[row : end + 1] - starts[row], langs.indices.to_numpy()[row:end], langs.dictionary
            row = end
        pa.default_memory_pool().release_unused()


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    names = [b"\0" + x.encode() for x in langs.to_pylist()]
    return string_hashes(np.frombuffer(b"".join(names), np.uint8), np.cumsum([0, *map(len, names)]))


def _kind(least: int):
    return np.min_scalar_type(least)


def _sketch(width: int, least: int, shortest: int, longest: int, sieve):
    """Count-min sketches of a task's n-grams: blocks of counts, each ``least`` at most, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((DEPTH, width), _kind(least))
        test = (lambda n, h: sieve.value.passes(h) if n <= 2 else None) if sieve else (lambda n, h: None)
        for data, starts, row_langs, langs in _parts(batches):
            for found in grams(data, starts, row_langs, _lang_hashes(langs), longest, test):
                if found.length < shortest:
                    continue
                for row in range(DEPTH):
                    cells = _cells(found.hashes, width, row)
                    order = np.argsort(cells)
                    heads = np.flatnonzero(np.diff(cells[order], prepend=-1))
                    hit = cells[order][heads]
                    counts[row, hit] = np.minimum(counts[row, hit].astype(np.int64) + np.add.reduceat(found.counts[order], heads), least)
        for row in range(DEPTH):
            for k in range(0, width, BLOCK):
                block = counts[row, k : k + BLOCK]
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([k // BLOCK], pa.int32()), pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())], ["row", "block", "counts"])

    return run


def _merged(least: int):
    """The sum of one block over all sketches, as a bit for each cell that reaches ``least``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for part in table.column("counts"):
            total += np.frombuffer(zlib.decompress(part.as_py()), _kind(least))
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    return run


def _sieve(texts: DataFrame, width: int, least: int, shortest: int, longest: int, sieve=None):
    """Sketch the n-grams of all texts, merge, and broadcast the cells that reach ``least`` (``DEPTH * width`` bits)."""
    schema = "row int, block int, counts binary"
    blocks = texts.coalesce(SKETCHES).mapInArrow(_sketch(width, least, shortest, longest, sieve), schema)
    bits = np.zeros((DEPTH, width // 8), np.uint8)
    for r in blocks.groupBy("row", "block").applyInArrow(_merged(least), "row int, block int, bits binary").collect():
        bits[r["row"], r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return texts.sparkSession.sparkContext.broadcast(Sieve(bits, width))


def _survivors(short, long, longest: int):
    """Counts of the n-grams that pass, and, with length 0, of all words of a language; a task adds up ``HELD`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = lambda n, h: (short if n <= 2 else long).value.passes(h)
        held: list[pa.RecordBatch] = []
        for data, starts, row_langs, langs in _parts(batches):
            for found in grams(data, starts, row_langs, _lang_hashes(langs), longest, test):
                if found.length == 1:
                    words = np.bincount(found.langs, found.counts, len(langs)).astype(np.int64)
                    held.append(_counted(langs, 0, pa.array([""] * len(langs)), words))
                kept = np.flatnonzero(test(found.length, found.hashes))
                if len(kept):
                    held.append(_counted(langs.take(pa.array(found.langs[kept])), found.length, found.names(kept), found.counts[kept]))
            if sum(map(len, held)) > HELD:
                held = _summed(held)
                if sum(map(len, held)) > HELD // 2:
                    yield from held
                    held = []
        yield from _summed(held)

    return run


def _summed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """One row for each language, length and phrase."""
    if not held:
        return []
    total = pa.Table.from_batches(held).group_by(["lang", "length", "phrase"]).aggregate([("a", "sum")])
    return total.select([0, 1, 2, 3]).rename_columns(["lang", "length", "phrase", "a"]).combine_chunks().to_batches()


def _counted(langs: pa.Array, length: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(counts), length, np.int32)), phrases, pa.array(counts.astype(np.int64))], ["lang", "length", "phrase", "a"])


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> DataFrame:
    """lang, length, phrase and exact count ``a`` of all phrases of 1 to ``longest`` words found ``least`` times.

    Rows of length 0 have the number of words of each language. Two passes sketch n-grams: first words and pairs, then
    longer ones whose pairs all pass. Sketches never count too little, so a third pass that adds up what passes exactly
    has everything frequent. Their width follows the size of the text up to ``MOST_CELLS``; beyond, more passes, and the
    exact count removes it. An n-gram is compared by its words, not by its hash.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))
    width = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // BYTES_EACH).bit_length()))
    short = _sieve(texts, width, least, 1, 2)
    long = _sieve(texts, width, least, 3, longest, short) if longest > 2 else short
    passed = texts.mapInArrow(_survivors(short, long, longest), "lang string, length int, phrase string, a long")
    return passed.groupBy("lang", "length", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("length") == 0))


def _exact(*factors: Column) -> Column:
    product = factors[0].cast("decimal(19,0)")
    for f in factors[1:]:
        product = (product * f.cast("decimal(19,0)")).cast("decimal(38,0)")
    return product


def score_phrases(counted: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the lowest-scoring cut of each phrase of two words or more."""
    totals = counted.where("length = 0").select("lang", F.col("a").alias("n"))
    parts = counted.where("length > 0")
    words = F.split("phrase", " ")
    cuts = parts.where("length > 1").select("lang", "phrase", "a", words.alias("words"), "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.col("length")), " ").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    scored = cuts.join(totals, "lang").withColumns({"over": _exact(F.lit(1000) * F.col("a"), F.col("n")), "under": _exact(F.col("l"), F.col("r"))}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut into pieces and words; a is the number of occurrences, overlaps included, at least
    ``least``. The score is floor(1000 * a * n / (l * r)) of the lowest-scoring cut into parts found l and r times, ties
    to the shorter first part; n is the number of words of the language. A phrase goes if a longer one around it has
    ``share`` percent of its occurrences: as counts never rise with length, one word more is enough to look at.

    Null texts count as empty, a null ``lang`` as ``und``. Repeated rows count each. Empty tables and texts without
    frequent phrases give an empty result. Other columns of ``docs`` are ignored.
    """
    counted = stage(frequent_phrases(docs, least, longest), "phrases")
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, 1, F.col("length") - 1), " "), F.array_join(F.slice(words, 2, F.col("length") - 1), " "))
    longer = counted.where("length > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = score_phrases(counted).join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a"))).drop("around")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = kept.withColumn("part", part).withColumn("turn", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("turn") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM t
), n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2
), cuts AS (
  SELECT c.lang, c.phrase, c.a, h.cut, l.a AS l, r.a AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM c JOIN n USING (lang), (SELECT unnest(range(1, 5)) AS cut) h, f l, f r
  WHERE h.cut < c.k AND l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:h.cut], ' ') AND r.lang = c.lang AND r.phrase = array_to_string(c.ws[h.cut + 1:c.k], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT c.lang, array_to_string(c.ws[s:s + m - 1], ' ') AS phrase, max(c.a) AS around
  FROM c, (SELECT unnest(range(2, 5)) AS m), (SELECT unnest(range(1, 5)) AS s) WHERE m < c.k AND s + m - 1 <= c.k GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN inner_parts i USING (lang, phrase) WHERE i.around IS NULL OR 100 * i.around < 100 * a
) WHERE rank <= 2000
"""
