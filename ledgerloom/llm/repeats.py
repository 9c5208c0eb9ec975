"""Operator 3, suffix-array dedup: bytes inside strings of 200 that occur elsewhere, by deep-shallow suffix sorting.

Sorting every suffix of a corpus would move each byte many times. A suffix is sorted only where it begins at an anchor.
In every string of ``LENGTH`` bytes the seed of ``SEED`` bytes with the smallest hash, leftmost on ties, is chosen; the
string then holds one of the two cores of ``CORE`` bytes that begin SIDE bytes before that seed, or with it. These cores
are the anchors. Equal strings have equal cores, so it is enough to compare the surroundings of equal cores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bytewise import chunks, mix, utf8
from ledgerloom.llm.staging import stage

LENGTH, SEED, CORE = 200, 40, 120
#: Most bytes before a core, and after it, that a string of LENGTH around it has.
SIDE = LENGTH - CORE
#: Texts longer than this are searched in pieces that overlap by LENGTH - 1 bytes.
PIECE_BYTES = 1 << 18
_PLACE_BITS = 21
#: Bytes by which suffixes are sorted before blind tries take over.
SHALLOW = 16
#: Bits of the filter of repeated cores, and its slices: 16 MB at any input size. More cores than it can tell apart only
#: let more single anchors through, which then find no partner.
FILTER_BITS, SLICES = 1 << 27, 64
_SLICE_BITS = FILTER_BITS // SLICES
#: Most anchors of one key that are sorted together, and rows at which a task begins to sort: it holds both at most.
CELL_ROWS, TOGETHER = 24_000, 4_000
#: Texts and surroundings that a partition remembers; what it forgets is compared again.
REMEMBERED = 200_000

_BYTE_VALUE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, number: int) -> np.ndarray:
    out = np.full(number, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSE = _powers(_BASE, 2 * PIECE_BYTES + 1), _powers(pow(_BASE, -1, 2**64), 2 * PIECE_BYTES + 1)


def pieces(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes with the row, first byte and end of each of their parts; the parts are whole texts or pieces of one."""
    for row, part, at in chunks(data, starts, PIECE_BYTES):
        if len(part) <= 2 * PIECE_BYTES:
            yield part, np.arange(row, row + len(at) - 1), at, np.zeros(len(at) - 1, np.int64)
        else:
            for a in range(0, len(part) - LENGTH + 1, PIECE_BYTES):
                piece = part[a : a + PIECE_BYTES + LENGTH - 1]
                yield piece, np.array([row]), np.array([0, len(piece)]), np.array([a])


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in the parts that begin at ``at``, and the hashes of their cores."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[data] * _POWERS[:n], dtype=np.uint64)))
    hashes = mix((prefix[SEED:] - prefix[:-SEED]) * _INVERSE[: n - SEED + 1])
    width = LENGTH - SEED + 1
    rows = -(-len(hashes) // width)
    key = np.full(rows * width, 2**64 - 1, np.uint64)
    key[: len(hashes)] = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
    square = key.reshape(rows, width)
    rising = np.minimum.accumulate(square, 1).ravel()
    falling = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    # strings begin at 0 .. n - LENGTH and must end within their part
    least = np.minimum(falling[: n - LENGTH + 1], rising[width - 1 : width + n - LENGTH])
    first = np.arange(n - LENGTH + 1)
    whole = first + LENGTH <= np.repeat(at[1:], np.diff(at))[: n - LENGTH + 1]
    seed, first = (least[whole] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64), first[whole]
    core = np.where(seed - first >= SIDE, seed - SIDE, seed)
    core = np.unique(core[np.concatenate(([True], core[1:] != core[:-1]))]) if len(core) else core
    return core, mix((prefix[core + CORE] - prefix[core]) * _INVERSE[core])


def text_id(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core, occurrence): the occurrence hashes text and place, so that copies of a text count once."""
    for batch in batches:
        data, starts = utf8(batch.column(0))
        for part, rows, at, first in pieces(data, starts):
            place, core = anchors(part, at)
            if len(place):
                own = np.array([int.from_bytes(text_id(bytes(data[starts[r] : starts[r + 1]]))[:8], "little") for r in rows], np.uint64)
                k = np.searchsorted(at, place, "right") - 1
                where = mix(own[k] + mix((place - at[k] + first[k]).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(where.view(np.int64))], ["core", "occurrence"])


def _probes(core: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Slice of each core, and its bits there."""
    own = core.view(np.uint64)
    again = mix(own + np.uint64(1))
    return (own % np.uint64(SLICES)).astype(np.int64), [(again >> np.uint64(s)).astype(np.int64) % _SLICE_BITS for s in (0, 21, 42)]


def _filter_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        slices, bits = _probes(batch.column(0).to_numpy())
        for s in np.unique(slices).tolist():
            flags = held.setdefault(s, np.zeros(_SLICE_BITS // 8, np.uint8))
            for b in bits:
                own = b[slices == s]
                np.bitwise_or.at(flags, own >> 3, (1 << (own & 7)).astype(np.uint8))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "bits"])


def _contexts(flags):
    """Surroundings of the anchors whose core may be repeated, once for each place in a distinct text of a partition.

    Surroundings that a partition meets a third time are repeated whole: those rows have no bytes, only their extent, and
    are compared with nothing. The first two stand for them. A partition remembers ``REMEMBERED`` texts and surroundings
    and then begins anew, which only gives rows that are compared once more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(flags.value, np.uint8)
        seen: set[bytes] = set()
        met: dict[bytes, int] = {}
        names = ["key", "text_id", "place", "before", "after", "bytes"]
        for batch in batches:
            data, starts = utf8(batch.column(0))
            fresh: dict[int, bytes] = {}
            if len(seen) > REMEMBERED:
                seen.clear()
            for r, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                if b - a >= LENGTH and (own := text_id(bytes(data[a:b]))) not in seen:
                    seen.add(own)
                    fresh[r] = own
            given = np.zeros(0, np.int64)
            for part, rows, at, first in pieces(data, starts):
                place, core = anchors(part, at)
                if first[0]:  # a later piece of a text: its overlap with the one before may give a place again
                    new = ~np.isin(place + first[0], given)
                    place, core, given = place[new], core[new], place + first[0]
                else:
                    given = place
                slices, probes = _probes(core)
                k = np.searchsorted(at, place, "right") - 1
                maybe = np.isin(rows[k], list(fresh))
                for p in probes:
                    bit = slices * _SLICE_BITS + p
                    maybe &= (bits[bit >> 3] >> (bit & 7) & 1).astype(bool)
                place, core, k = place[maybe], core[maybe], k[maybe]
                if not len(place):
                    continue
                # the surroundings come from the whole text: a piece may end sooner
                here = starts[rows[k]] + place - at[k] + first[k]
                if len(met) > REMEMBERED:
                    met.clear()
                a, b = np.maximum(starts[rows[k]], here - SIDE), np.minimum(starts[rows[k] + 1], here + LENGTH)
                strings: list[bytes | None] = []
                for lo, hi, at_core in zip(a.tolist(), b.tolist(), here.tolist()):
                    own = bytes(data[lo:hi])
                    key = hashlib.md5(b"%d " % (at_core - lo) + own, usedforsecurity=False).digest()
                    met[key] = met.get(key, 0) + 1
                    strings.append(own if met[key] <= 2 else None)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array([fresh[r] for r in rows[k].tolist()], pa.binary()), pa.array(here - starts[rows[k]]), pa.array(here - a), pa.array(b - here), pa.array(strings, pa.binary())], names)

    return run


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by the bytes at which they branch; an insertion compares with one stored string only.

    A node is [depth, {byte at depth, or -1 at the end of a string: node or leaf}]; a leaf is a list of equal strings'
    numbers.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [0]
        for i in range(1, len(strings)):
            self._insert(i)

    def _first(self, node: list) -> int:
        while isinstance(node[-1], dict):
            node = next(iter(node[-1].values()))
        return node[0]

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        node = self.root
        while isinstance(node[-1], dict):
            depth, branches = node
            child = branches.get(s[depth] if depth < len(s) else -1)
            node = child if child is not None else next(iter(branches.values()))
        other = self.strings[node[0]]
        if other == s:
            node.append(i)
            return
        at = common_prefix(s, other)
        own, theirs = (s[at] if at < len(s) else -1), (other[at] if at < len(other) else -1)
        parent, node = None, self.root
        while isinstance(node[-1], dict) and node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node[-1], dict) and node[0] == at:
            node[1][own] = [i]
            return
        branch = [at, {theirs: node, own: [i]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0]]] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings' numbers in order, and each one's common prefix with the one before (0 for the first)."""
        order: list[int] = []
        shared: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node[-1], dict):
                for n, key in enumerate(sorted(node[1], reverse=True), 1):
                    stack.append((node[1][key], depth if n == len(node[1]) else node[0]))
            else:
                order += node
                shared += [depth] + [len(self.strings[node[0]])] * (len(node) - 1)
        return order, shared


def multikey_quicksort(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in order of group and words, and for each place the first place of its class of equal rows.

    All classes are divided at once: a member's word at the class's depth is the pivot, the others go below, to or above
    it, and what equals it goes on with the next word.
    """
    order = np.argsort(group, kind="stable")
    found = np.arange(len(group))
    step = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    first = found[step][np.cumsum(step) - 1]
    depth = np.zeros(len(group), np.int64)
    open_ = np.repeat(np.diff(np.append(np.flatnonzero(step), len(group))) > 1, np.diff(np.append(np.flatnonzero(step), len(group))))
    while len(at := found[open_]):
        row, own = order[at], first[at]
        value = words[row, depth[at]]
        head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(np.append(head, len(at)))
        pivot = np.repeat(value[head + size // 2], size)
        side = (value >= pivot).astype(np.int8) + (value > pivot)
        turn = np.lexsort((side, own))
        order[at], side = row[turn], side[turn]
        step = np.concatenate(([True], (own[1:] != own[:-1]) | (side[1:] != side[:-1])))
        head = np.flatnonzero(step)
        first[at] = at[head][np.cumsum(step) - 1]
        depth[at] += side == 1
        size = np.diff(np.append(head, len(at)))
        open_[at] = (np.repeat(size, size) > 1) & (depth[at] < words.shape[1])
    return order, first


class Strings:
    """Parts of the rows of a binary column: ``size`` bytes each from ``at``, onwards or (``step`` -1) backwards."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, step: int):
        self.data, self.at, self.size, self.step = data, at, size, step

    def heads(self, width: int) -> np.ndarray:
        """The first bytes of each, filled up with zeros."""
        k = np.arange(width)
        place = np.clip(self.at[:, None] + self.step * k, 0, max(0, len(self.data) - 1))
        return np.where(k < self.size[:, None], self.data[place], 0).astype(np.uint8)

    def __getitem__(self, i: int) -> bytes:
        a, n = int(self.at[i]), int(self.size[i])
        return self.data[a : a + n].tobytes() if self.step == 1 else self.data[a - n + 1 : a + 1].tobytes()[::-1]


def suffix_order(group: np.ndarray, strings: Strings) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow order of strings within their groups, and common prefixes with the one before (-1 at a group's start).

    Multikey quicksort by words of eight bytes to a depth of SHALLOW; blind tries order what is still equal then.
    """
    head, size = strings.heads(SHALLOW), strings.size
    order, first = multikey_quicksort(group, head.view(">u8").astype(np.uint64))
    shared = np.full(len(size), -1, np.int64)
    a, b = order[:-1], order[1:]
    equal = np.logical_and.accumulate(head[a] == head[b], axis=1).sum(1)
    shared[1:] = np.where(group[a] == group[b], np.minimum(equal, np.minimum(size[a], size[b])), -1)
    bounds = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1], [True])))
    for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
        lo, hi = bounds[k], bounds[k + 1]
        own = order[lo:hi]
        trie_order, trie_shared = BlindTrie([strings[i] for i in own.tolist()]).ordered()
        order[lo:hi] = own[trie_order]
        shared[lo + 1 : hi] = trie_shared[1:]
    return order, shared


def repeated_extent(group: np.ndarray, before: Strings, after: Strings, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and most bytes before its core, from ``low`` to ``high``, of a repeated string (-1: none).

    ``before``: the bytes before the core, nearest first; ``after``: those after it. A string with d bytes before is
    repeated if another anchor of the group has the same d bytes before and SIDE - d after: if both are in one run of
    the first order with common prefixes of d or more, and in one of the second order with SIDE - d or more.
    """
    n = len(group)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    left_order, left_shared = suffix_order(group, before)
    right_order, right_shared = suffix_order(group, after)
    low, high = np.maximum(low, SIDE - after.size), np.minimum(high, before.size)
    left_run, right_run = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(max(0, int(low.min())), min(SIDE, int(high.max())) + 1):
        whole = np.flatnonzero((low <= d) & (d <= high))
        left_run[left_order] = np.cumsum(left_shared < d)
        right_run[right_order] = np.cumsum(right_shared < SIDE - d)
        key = left_run[whole] * (n + 1) + right_run[whole]
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        hit = whole[twice]
        most[hit] = d
        least[hit[least[hit] < 0]] = d
    return least, most


_SPANS = "text_id binary, a long, b long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of texts, from anchors sorted by key; a key of hot anchors has at most CELL_ROWS."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def compared(table: pa.Table) -> pa.RecordBatch:
        keys, places, texts = table["key"].to_numpy(), table["place"].to_numpy(), table["text_id"]
        # equal keys are only equal hashes: the cores themselves decide
        core = pc.binary_join_element_wise(pa.array([b"%d " % k for k in keys.tolist()], pa.binary()), _middle(table), b"")
        group = core.dictionary_encode().indices.to_numpy().astype(np.int64)
        # a text that several partitions have met is one
        text = texts.combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        own = np.unique(np.stack((group, text, places)), axis=1, return_index=True)[1]
        own = own[np.bincount(group[own])[group[own]] > 1]
        if not len(own):
            return _batch([], own, own)
        taken = table.take(pa.array(own))
        data, starts = _binary(taken["bytes"])
        cut, size = taken["before"].to_numpy(), np.diff(starts)
        before = Strings(data, starts[:-1] + cut - 1, np.minimum(cut, SIDE), -1)
        after = Strings(data, starts[:-1] + cut + CORE, size - cut - CORE, 1)
        least, most = repeated_extent(group[own], before, after, taken["low"].to_numpy(), taken["high"].to_numpy())
        hit = np.flatnonzero(most >= 0)
        place = places[own[hit]]
        return _batch(taken["text_id"].take(pa.array(hit)).combine_chunks(), place - most[hit], place - least[hit] + LENGTH)

    def ready(last: bool) -> Iterator[pa.RecordBatch]:
        """The groups that surely have ended, or all at the end."""
        nonlocal held, rows
        table = pa.Table.from_batches(held)
        end = table.num_rows
        if not last:
            keys = table["key"].to_numpy()
            differs = np.flatnonzero(keys != keys[-1])
            end = int(differs[-1]) + 1 if len(differs) else 0
        if end:
            yield compared(table.slice(0, end))
        held = table.slice(end).combine_chunks().to_batches()
        rows = table.num_rows - end

    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            held.append(pa.concat_batches([batch.slice(at, TOGETHER)]))
            rows += held[-1].num_rows
            if rows >= TOGETHER:
                yield from ready(False)
        pa.default_memory_pool().release_unused()
    if held:
        yield from ready(True)


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls and where each row starts."""
    column = column.combine_chunks()
    _, starts, data = column.buffers()
    return np.frombuffer(data, np.uint8), np.frombuffer(starts, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _middle(table: pa.Table) -> pa.Array:
    """The cores of rows of surroundings."""
    data, starts = _binary(table["bytes"])
    first = starts[:-1] + table["before"].to_numpy()
    values = data[first[:, None] + np.arange(CORE)].tobytes()
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.arange(len(first) + 1) * CORE).astype(np.int32)), pa.py_buffer(values)])


def _batch(texts, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["text_id", "a", "b"])


def _sorted_spans(cells: DataFrame) -> DataFrame:
    return cells.select("key", "low", "high", "text_id", "place", "before", "after", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(_compare, _SPANS)


def _split(rows: DataFrame) -> DataFrame:
    """Each row of a hot key under two finer keys, each for one half of the numbers of bytes before the core.

    All strings with low to high bytes before the core have ``low`` bytes before it and LENGTH - ``high`` from it on in
    common. Half the numbers have more in common, so the rows of a key fall apart by what they have there.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("high").alias("h"))))
    halved = rows.withColumn("half", half).withColumns({"low": F.col("half.l"), "high": F.col("half.h")}).drop("half")
    has = (F.col("low") <= F.col("high")) & (F.greatest("low", LENGTH - F.col("after")) <= F.least("high", "before"))
    common = F.expr(f"substring(bytes, CAST(before - low + 1 AS INT), low + {LENGTH} - high)")
    return halved.where(has).withColumn("key", F.xxhash64("key", "low", common))


def _hot_spans(rows: DataFrame) -> DataFrame:
    """Spans of the anchors of hot cores: keys are made finer until each has at most CELL_ROWS anchors.

    In each round rows that have all bytes of a key's strings in common are repeated, and two of them stand for the
    others. What is still too large is split. A key with one string left has at most two rows, so seven rounds suffice.
    """
    found = None
    while True:
        rows = stage(_split(rows), "hot-anchors")
        full = (F.col("before") >= F.col("high")) & (F.col("after") >= LENGTH - F.col("low"))
        string = F.when(full, F.expr(f"substring(bytes, CAST(before - high + 1 AS INT), {LENGTH} + high - low)"))
        rows = rows.withColumn("string", F.md5(string))
        place = F.struct("text_id", "place")
        twice = stage(rows.where("string IS NOT NULL").groupBy("key", "string").agg(F.min(place).alias("l"), F.max(place).alias("h")).where("l <> h"), "hot-strings")
        marked = rows.join(twice, ["key", "string"], "left")
        part = marked.where("l IS NOT NULL").select("text_id", (F.col("place") - F.col("high")).alias("a"), (F.col("place") - F.col("low") + LENGTH).alias("b"))
        rows = stage(marked.where((F.col("l").isNull()) | (place == F.col("l")) | (place == F.col("h"))).drop("string", "l", "h"), "hot-rest")
        large = stage(rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("high") - F.col("low")).alias("more")).where((F.col("n") > CELL_ROWS) & (F.col("more") > 0)), "hot-keys")
        part = part.unionByName(_sorted_spans(rows.join(large, "key", "left_anti")))
        found = part if found is None else found.unionByName(part)
        rows = rows.join(large, "key", "left_semi")
        if large.isEmpty():
            return found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(text_id, a, b): byte spans of texts that LENGTH-byte strings occurring elsewhere cover; they may overlap.

    A text with copies is not repeated by these: ``remove_repeats`` removes it whole. ``text_id`` is its MD5.
    """
    spark = docs.sparkSession
    texts = docs.where(F.octet_length("text") >= LENGTH).select("text")
    cores = texts.mapInArrow(_cores, "core long, occurrence long").groupBy("core").agg(F.min("occurrence").alias("low"), F.max("occurrence").alias("high"))
    repeated = cores.where("low <> high").select("core")
    parts = repeated.repartition(SLICES, F.pmod("core", F.lit(SLICES))).mapInArrow(_filter_slices, "slice long, bits binary").collect()
    flags = np.zeros((SLICES, _SLICE_BITS // 8), np.uint8)
    for r in parts:
        flags[r["slice"]] |= np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(flags.tobytes())
    found = stage(texts.mapInArrow(_contexts(sent), "key long, text_id binary, place long, before long, after long, bytes binary"), "anchors")
    whole = found.where("bytes IS NULL").select("text_id", (F.col("place") - F.col("before")).alias("a"), (F.col("place") + F.col("after")).alias("b"))
    found = found.where("bytes IS NOT NULL").withColumns({"low": F.lit(0), "high": F.lit(SIDE)})
    hot = stage(found.groupBy("key").count().where(F.col("count") > CELL_ROWS).select("key"), "hot-cores")
    if hot.isEmpty():
        return _sorted_spans(found).unionByName(whole)
    return _sorted_spans(found.join(hot, "key", "left_anti")).unionByName(whole).unionByName(_hot_spans(found.join(hot, "key", "left_semi")))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's spans and what is left, for (doc_id, text, copies, spans)."""
    for batch in batches:
        rows = []
        for doc_id, text, copies, spans in zip(*(batch.column(i) for i in range(4))):
            own = (text.as_py() or "").encode()
            runs = [(0, len(own))] if (copies.as_py() or 1) > 1 and len(own) >= LENGTH else merge([(s["a"], s["b"]) for s in spans.as_py() or []])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(own[at:a])
                at = b
            kept.update(own[at:])
            rows.append((doc_id.as_py(), len(own), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row: bytes inside repeated strings of LENGTH bytes go.

    Anchors with equal cores are sorted together; a core with more than ``CELL_ROWS`` anchors falls apart by the bytes
    around it (``_split``), so no task sorts a very common passage alone. A text that occurs twice or more is removed whole if it has LENGTH
    bytes. What is removed is judged on the input, and a string may occur again in the same text.

    Null and empty texts have no bytes. Repeated rows are copies of each other. An empty table gives an empty result.
    Other columns of ``docs`` are ignored.
    """
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_id")
    spans = stage(repeated_spans(docs), "repeated-spans").groupBy("text_id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    copies = docs.select(key).groupBy("text_id").agg(F.count("*").alias("copies")).where("copies > 1")
    facts = copies.join(spans, "text_id", "full_outer")
    return docs.select("doc_id", "text", key).join(facts, "text_id", "left").select("doc_id", "text", "copies", "spans").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
