"""Operator 2, n-gram Jaccard join: MinHash candidates, Bayesian pruning by increments, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bytewise import mix, shingle_sets
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.staging import stage

WIDTH, THRESHOLD = 5, 0.8
#: Two documents at the threshold miss all bands once in 300,000 times: (1 - 0.8 ** 5) ** 32.
BANDS, BAND_ROWS = 32, 5
#: MinHash values compared at a time, and in all, before a pair is verified.
STEP, MOST = 32, 128
#: A pair goes when the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-6
#: Shingles of a block of documents: a task holds two blocks.
BLOCK_SHINGLES = 500_000

_MULTIPLIERS = np.random.default_rng(77).integers(0, 2**63, max(MOST, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(sets: list[np.ndarray], number: int) -> np.ndarray:
    """``number`` MinHash values of each non-empty set, a row each."""
    out = np.empty((len(sets), number), np.uint64)
    if sets:
        joined = np.concatenate(sets)
        heads = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        for k in range(number):
            out[:, k] = np.minimum.reduceat(joined * _MULTIPLIERS[k], heads)
    return out


def least_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values among ``compared`` at which a pair stays.

    With a uniform prior, the similarity after m of n matches has a Beta(m + 1, n - m + 1) distribution, which exceeds t
    with the probability that a Binomial(n + 1, t) variable is at most m.
    """
    n, total = compared + 1, 0.0
    for m in range(n):
        total += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return compared


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "set_a", "set_b", "n_shingles", "bands"]
    for batch in batches:
        rows, sets, held = [], [], 0

        def flush() -> pa.RecordBatch:
            values = minhash(sets, BANDS * BAND_ROWS).reshape(len(sets), BANDS, BAND_ROWS)
            bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy()
            for k in range(BAND_ROWS):
                bands = mix(bands * np.uint64(31) + values[:, :, k])
            key = lambda salt: pa.array(np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), key(0x5BD1E995), key(0xC2B2AE35), pa.array([len(s) for s in sets], pa.int64()), lists], names)

        for row, found in shingle_sets(batch.column(1), WIDTH):
            rows.append(row)
            sets.append(found)
            held += len(found)
            if held > 200_000:
                yield flush()
                rows, sets, held = [], [], 0
        if sets:
            yield flush()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        others = [n for n in batch.schema.names if n != "text"]
        rows, sets = [], []
        for row, found in shingle_sets(batch.column("text"), WIDTH):
            rows.append(row)
            sets.append(found.tobytes())
        if rows:
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in others], pa.array(sets, pa.binary())], [*others, "shingles"])


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of ``left`` with the rows of ``right`` (None: the later rows of ``left``) that reach the threshold.

    MinHash values are compared in increments; whoever can still reach the threshold is counted exactly.
    """
    size = np.array([len(s) for s in sets])
    values = minhash(sets, MOST).astype(np.uint32)
    limits = [(n, least_matches(n, threshold)) for n in range(STEP, MOST + 1, STEP)]
    vocabulary, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(size)))
    local = [place[a:b] for a, b in zip(starts[:-1], starts[1:])]
    flags = np.zeros(len(vocabulary), bool)
    for k, i in enumerate(left):
        others = left[k + 1 :] if right is None else right
        small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        others = others[small >= threshold * large]
        matches = np.zeros(len(others), np.int32)
        for n, least in limits:
            if not len(others):
                break
            matches += (values[others, n - STEP : n] == values[i, n - STEP : n]).sum(1, dtype=np.int32)
            kept = matches >= least
            others, matches = others[kept], matches[kept]
        if not len(others):
            continue
        flags[local[i]] = True
        heads = np.concatenate(([0], np.cumsum(size[others])[:-1]))
        common = np.add.reduceat(flags[np.concatenate([local[j] for j in others])], heads, dtype=np.int64)
        flags[local[i]] = False
        yield i, others[common >= threshold * (size[i] + size[others] - common) - 1e-9]


def _cell(table: pa.Table) -> pa.Table:
    """Links within one cell: each document's number of linked documents, and the smallest document of its cluster."""
    # rows that repeat a document count once
    first = {key: i for i, key in reversed(list(enumerate(zip(table["node"].to_pylist(), (s.as_py() for s in table["shingles"])))))}
    table = table.take(pa.array(sorted(first.values(), key=lambda i: table["node"][i].as_py())))
    node, copies, block = (table[c].to_numpy() for c in ("node", "copies", "block"))
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["shingles"]]
    x, y = table["x"][0].as_py(), table["y"][0].as_py()
    root = np.arange(len(node))
    links = np.zeros(len(node), np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if len(node) > 1:
        for i, linked in similar_pairs(sets, np.flatnonzero(block == x), None if x == y else np.flatnonzero(block == y)):
            linked = linked[node[linked] != node[i]]
            links[i] += copies[linked].sum()
            links[linked] += copies[i]
            for j in linked:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return pa.table({"node": node, "links": links, "root": node[[find(i) for i in range(len(node))]]})


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per doc_id: class_id, the smallest doc_id of those that links join, and n_links, its number of linked documents.

    Two documents are linked if their sets of five-word shingles (hashed to 64 bits) have a Jaccard similarity of 0.8 or
    more. Documents with equal sets are one node, counted by its copies. Nodes that share a MinHash band are
    candidates, and all pairs within a connected group of candidates are compared: MinHash values by increments, with
    pairs dropped as soon as their posterior probability of reaching the threshold is below ``TOLERANCE``, then exactly.
    Groups are cut into blocks of ``BLOCK_SHINGLES``, and a task compares two blocks, so no task holds a group; pairs
    are counted where they are found and never become rows.

    Fewer than five words make one shingle; null, empty and wordless texts have none and are linked to nothing. Rows
    that repeat a doc_id count as one document. Rows without doc_id form one row without class. An empty table gives an
    empty result. Other columns of ``docs`` are ignored.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    signed = stage(known.mapInArrow(_signatures, "doc_id long, set_a long, set_b long, n_shingles long, bands array<long>"), "near-signatures")
    classes = stage(signed.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.countDistinct("doc_id").alias("copies"), F.max("n_shingles").alias("n_shingles")), "near-classes")
    nodes = signed.withColumnRenamed("doc_id", "node").join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b", "node"], "left_semi")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = keys.join(shared, "key").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    groups = connected_components(edges)

    sizes = classes.groupBy("node").agg(F.sum("copies").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    members = groups.join(sizes, "node")
    blocks = members.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = members.join(blocks, "component").select("component", "node", "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = known.withColumnRenamed("doc_id", "node").join(members, "node").select("component", "node", "copies", "blocks", "block", "text")
    sets = texts.mapInArrow(_sets, "component long, node long, copies long, blocks int, block int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = sets.withColumn("other", other).select("component", "node", "copies", "block", "shingles", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    linked = stage(cells.groupBy("component", "x", "y").applyInArrow(_cell, "node long, links long, root long"), "near-links")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))

    named = classes.join(links, "node", "left").join(joined, "node", "left")
    named = named.select("set_a", "set_b", F.coalesce("component", "node").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = signed.select("doc_id", "set_a", "set_b").join(named, ["set_a", "set_b"]).select("doc_id", "class_id", "n_links")
    rest = docs.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(rest).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row, with all columns, for the smallest doc_id of each class; of rows that repeat it, the first by text.

    Rows without doc_id stay, and so does a text without words, null or empty, for each doc_id, as it is no copy of
    another. An empty table gives an empty result. Columns may have any names.
    """
    first = near_copies(docs).where("doc_id = class_id").select("doc_id")
    kept = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").select(*docs.columns)
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[c for c in ("text", "source", "lang") if c in docs.columns]))
    place = "turn" + "_" * (1 + max(map(len, docs.columns)))
    return kept.withColumn(place, turn).where(F.col(place) == 1).drop(place).unionByName(docs.where(F.col("doc_id").isNull()))
