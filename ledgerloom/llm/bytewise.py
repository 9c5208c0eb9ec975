"""Whole columns of text as byte arrays: word counts and word hashes without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one vectorised step may hold; its work arrays take about 60 times as much.
CHUNK_BYTES = 1 << 19

_RNG = np.random.default_rng(20240607)
#: A random 64-bit value for each byte value, and a random odd multiplier: the word hash is a polynomial over them.
_BYTE_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts (one more entry than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if starts else np.zeros(len(column) + 1, int)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), starts.astype(np.int64)


def chunks(data: np.ndarray, starts: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes (a longer row alone): first row, bytes, starts within them."""
    row, rows = 0, len(starts) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + most, "right")) - 1)
        yield row, data[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


def slices(batches: Iterator[pa.RecordBatch], most: int = 2 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of whole rows of about ``most`` bytes of ``text`` (a longer row alone).

    Python objects, and what goes back to the JVM, then grow with a part and not with a batch; freed Arrow memory is
    handed back to the system after each batch.
    """
    for batch in batches:
        _, starts = utf8(batch.column("text"))
        row, rows = 0, batch.num_rows
        while row < rows:
            end = max(row + 1, int(np.searchsorted(starts, starts[row] + most, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end
        pa.default_memory_pool().release_unused()


def _word_starts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    letters = ~_IS_SPACE[data]
    fresh = letters.copy()
    fresh[1:] &= ~letters[:-1]
    heads = starts[:-1][starts[:-1] < len(data)]
    fresh[heads] = letters[heads]
    return letters, fresh


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words, maximal runs of other bytes than space, tab, newline, \\v, \\f and \\r, of each row."""
    data, starts = utf8(column)
    out = np.zeros(len(starts) - 1, np.int64)
    for row, part, at in chunks(data, starts, 8 * CHUNK_BYTES):
        if len(part):
            total = np.concatenate(([0], np.cumsum(_word_starts(part, at)[1], dtype=np.int64)))
            out[row : row + len(at) - 1] = np.diff(total[at])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the rows, in order, and where each row's words start."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    letters, fresh = _word_starts(data, starts)
    word_of_byte = np.cumsum(fresh, dtype=np.int64)
    first = np.flatnonzero(fresh)
    row_words = np.concatenate(([0], word_of_byte))[starts]
    if not len(first):
        return np.zeros(0, np.uint64), row_words
    place = np.arange(len(data))[letters]
    inside = place - first[word_of_byte[letters] - 1]
    power = np.cumprod(np.full(int(inside.max()) + 1, _BASE, np.uint64), dtype=np.uint64)
    value = _BYTE_VALUE[data[letters]] * power[inside]
    heads = np.flatnonzero(fresh[letters])
    return mix(np.add.reduceat(value, heads)), row_words


def string_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string of a column, none of which is empty; ``starts`` has one entry more than there are."""
    if len(starts) < 2:
        return np.zeros(0, np.uint64)
    size = np.diff(starts)
    inside = np.arange(starts[0], starts[-1]) - np.repeat(starts[:-1], size)
    power = np.cumprod(np.full(int(size.max()) + 1, _BASE, np.uint64), dtype=np.uint64)
    return mix(np.add.reduceat(_BYTE_VALUE[data[starts[0] : starts[-1]]] * power[inside], starts[:-1] - starts[0]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct 64-bit shingle hashes of each row with a word; fewer words make one shingle."""
    data, starts = utf8(column)
    for row, part, at in chunks(data, starts):
        words, row_words = word_hashes(part, at)
        if len(words) < width:
            grams = np.zeros(0, np.uint64)
        else:
            grams = words[: len(words) - width + 1].copy()
            for k in range(1, width):
                grams = mix(grams * _BASE + words[k : len(words) - width + 1 + k])
        for r, (a, b) in enumerate(zip(row_words[:-1].tolist(), row_words[1:].tolist())):
            if b - a >= width:
                yield row + r, np.unique(grams[a : b - width + 1])
            elif b > a:
                short = words[a : a + 1].copy()
                for k in range(a + 1, b):
                    short = mix(short * _BASE + words[k : k + 1])
                yield row + r, short
