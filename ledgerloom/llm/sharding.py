"""Operator 4, sharding: a minimax contiguous partition of atomic groups, in DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.staging import stage

#: Rows of one range of hashes are numbered in so many separate cells, so that no task has to hold all copies of a text.
CELLS = 256
#: Bits of a hash by which a range is divided when a cut falls into it.
FINER = 8


@dataclass(frozen=True)
class Piece:
    """The texts whose hash, shifted right by ``shift``, is ``prefix``: their bytes, and whether they are several."""

    prefix: int
    shift: int
    size: int
    several: bool

    @property
    def first(self) -> int:
        return self.prefix << self.shift


def greedy_cuts(before: list[int], capacity: int, shards: int) -> tuple[list[int], bool]:
    """Positions of the pieces that a greedy pass puts first into each shard but the first, and whether all fit.

    ``before``: bytes before each piece, and of all at the end. A pass that doesn't fit ends with the piece at which it
    fails.
    """
    cuts: list[int] = []
    at = 0
    while (end := bisect_right(before, before[at] + capacity) - 1) < len(before) - 1:
        cuts.append(end)
        if end == at or len(cuts) == shards:
            return cuts, False
        at = end
    return cuts, True


def smallest_capacity(before: list[int], shards: int) -> int:
    """By bisection between the mean and the sum, the smallest capacity for which a greedy pass fits."""
    low, high = -(-before[-1] // shards), before[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy_cuts(before, middle, shards)[1] else (middle + 1, high)
    return low


def pieces_of(rows: DataFrame, shift: int, prefixes: list[int] | None = None) -> list[Piece]:
    """Pieces of ``rows`` (hash, size), or of those under ``prefixes`` with FINER bits more: a bounded number of them."""
    finer = shift - FINER if prefixes is not None else shift
    found = rows if prefixes is None else rows.where(F.shiftright("hash", shift).isin(prefixes))
    sums = found.groupBy(F.shiftright("hash", finer).alias("prefix")).agg(F.sum("size").alias("size"), (F.min("hash") < F.max("hash")).alias("several"))
    return [Piece(r["prefix"], finer, r["size"], r["several"]) for r in sums.collect()]


def minimax_cuts(rows: DataFrame, shards: int, bits: int) -> list[int]:
    """The first hash of each shard but the first, for the smallest capacity over single texts in order of their hash.

    Pieces begin as ``2**bits`` ranges of hashes. The pieces at which the greedy pass cuts, with the capacity found and
    with one byte less, are divided until each is one text: then finer pieces elsewhere would change neither pass, so
    the one fits and the other doesn't for single texts either. A round divides at most ``2 * shards`` pieces, so the
    table of sizes that the driver holds grows by ``2 * shards * 2**FINER`` numbers a round.
    """
    pieces = sorted(pieces_of(rows, 64 - bits), key=lambda p: p.first)
    while pieces:
        before = [0, *accumulate(p.size for p in pieces)]
        capacity = smallest_capacity(before, shards)
        cuts, _ = greedy_cuts(before, capacity, shards)
        met = {*cuts, *greedy_cuts(before, capacity - 1, shards)[0]}
        coarse = {pieces[i] for i in met if pieces[i].several}
        if not coarse:
            return [pieces[i].first for i in cuts]
        pieces = [p for p in pieces if p not in coarse]
        for shift in {p.shift for p in coarse}:
            pieces += pieces_of(rows, shift, [p.prefix for p in coarse if p.shift == shift])
        pieces.sort(key=lambda p: p.first)
    return []


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8, bucket_bits: int = 16) -> DataFrame:
    """Put every row into a shard so that shard sizes in bytes are near equal and equal texts stay together.

    Atomic groups are the rows of one text, in order of a 64-bit hash of it. The law is ``bytes``: the largest shard is
    the smallest possible for that order (``minimax_cuts``). Slots count within ranges of hashes first, and then over
    the table of ranges, so no task numbers a whole shard.

    A null text has no bytes and shares the group of the empty text; its CRC is 0. Repeated rows each get a slot. An
    empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    # rows of one text and id, too, are spread over cells
    rows = rows.withColumns({"bucket": F.shiftright("hash", 64 - bucket_bits), "cell": F.pmod(F.xxhash64("row"), F.lit(CELLS)).cast("int")})
    rows = stage(rows, "shard-rows")
    shard = sum((F.when(F.col("hash") >= F.lit(b), 1).otherwise(0) for b in minimax_cuts(rows, shards, bucket_bits)), F.lit(0)).cast("int")
    rows = rows.withColumn("shard", shard)
    cells = stage(rows.groupBy("shard", "bucket", "cell").agg(F.count("*").alias("n")), "shard-cells")
    buckets = cells.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.select("shard", "bucket", F.coalesce(F.sum("n").over(before("shard", "bucket")), F.lit(0)).alias("base"))
    within = cells.select("shard", "bucket", "cell", F.coalesce(F.sum("n").over(before("shard", "bucket", "cell")), F.lit(0)).alias("in_bucket"))
    places = within.join(bases, ["shard", "bucket"]).select("shard", "bucket", "cell", (F.col("base") + F.col("in_bucket")).alias("base"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket", "cell").orderBy("hash", "doc_id", "row")) - 1
    return (
        rows.withColumn("own", own)
        .join(places, ["shard", "bucket", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
