"""One row for each story: items with one address, or with titles nearly alike and published close together."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from ledgerloom.checkpoints import cut
from ledgerloom.operators.graph import groups
from ledgerloom.operators.text import canonical_url, normalised_title

#: Titles are alike from this ratio of matching characters on; only if published within so many hours.
ALIKE, HOURS = 0.9, 48
ANNOUNCEMENT = "announcement"
#: Titles of a block, of a strip of one, pairs of blocks of a task, and tasks at least.
BLOCK, STRIP, TILES, TASKS = 4096, 512, 4, 96
#: Bits of a title's mark.
BITS = 1024


@F.pandas_udf(DoubleType())
def matching_ratio(later: pd.Series, earlier: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters, as ``difflib`` finds them; 0 if a title is empty."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(later, earlier)], dtype=float)


@F.pandas_udf(BinaryType())
def _mark(titles: pd.Series) -> pd.Series:
    """How many runs of three a title has, as eight bytes, and a set of bits with one for each by its hash."""
    def mark(title: str) -> bytes:
        runs, bits = _runs(title), 0
        for run in runs:
            bits |= 1 << zlib.crc32(run.encode()) % BITS
        return len(runs).to_bytes(8, "little") + bits.to_bytes(BITS // 8, "little")

    return titles.map(mark)


def _runs(title: str) -> set[str]:
    return {title[i : i + 3] for i in range(len(title) - 2)}


def _shared(grams: np.ndarray, lengths: np.ndarray, alike: float) -> np.ndarray:
    """How many of its runs of three a title has in common at least with any title alike, one at least.

    Of both titles' characters, at most the share 1 - alike doesn't match. One of the title's own breaks three of its
    runs, one of the other's two; that is the most where the other title is as short as it may be.
    """
    broken = 2.5 * (1 - alike) * (1 + alike / (2 - alike)) + 0.5 * (1 - alike / (2 - alike))
    return np.maximum(1, grams - np.floor(broken * lengths + 1e-9))


def _likely(alike: float):
    """The pairs of two blocks of titles that are near in length and have enough runs of three in common.

    A bit that only one title's mark has is a run, at least, that only it has. What the marks leave is bounded by the
    characters in common, in any order, and then counted by the runs.
    """
    least = alike / (2 - alike)

    def read(side: pa.StructArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        titles = side.field("title").to_pylist()
        marks = np.frombuffer(b"".join(side.field("mark").to_pylist()), "<u8").reshape(len(titles), -1)
        grams, bits, lengths = marks[:, 0].astype(np.int32), np.ascontiguousarray(marks[:, 1:].T), np.array([len(t) for t in titles])
        needed = _shared(grams, lengths, alike).astype(np.int32)
        letters = np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), "<u4") % 64, minlength=64) for t in titles], np.int16)
        return titles, bits, lengths, needed, letters, grams - np.bitwise_count(bits).sum(0, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch["same"][k].as_py()
                (one, bits1, length1, needed1, letters1, spare1), (other, bits2, length2, needed2, letters2, spare2) = (read(batch[c][k].values) for c in ("one", "other"))
                pairs = []
                for i in range(0, len(one), STRIP):
                    for j in range(i if same else 0, len(other), STRIP):
                        a, b = slice(i, i + STRIP), slice(j, j + STRIP)
                        met = np.zeros((len(length1[a]), len(length2[b])), np.int16)
                        for x, y in zip(bits1[:, a], bits2[:, b]):
                            met += np.bitwise_count(np.bitwise_and.outer(x, y))
                        enough = np.maximum.outer(needed1[a], needed2[b])
                        held = met + np.minimum.outer(spare1[a], spare2[b]) >= enough
                        held &= np.minimum.outer(length1[a], length2[b]) >= least * np.maximum.outer(length1[a], length2[b]) - 1e-9
                        r, c = np.nonzero(np.triu(held, 1) if same and i == j else held)
                        matched = np.minimum(letters1[a][r], letters2[b][c]).sum(1, dtype=np.int32)
                        left = 2 * matched >= alike * (length1[a][r] + length2[b][c]) - 1e-9
                        r, c = r[left], c[left]
                        for x, y, n in zip(r, c, enough[r, c]):
                            p, q = one[i + x], other[j + y]
                            if p != q and len(_runs(p) & _runs(q)) >= n:
                                pairs.append((min(p, q), max(p, q)))
                yield pa.RecordBatch.from_pydict({"one": pa.array([p[0] for p in pairs], pa.string()), "other": pa.array([p[1] for p in pairs], pa.string())})

    return run


def similar_titles(titles: DataFrame, alike: float = ALIKE) -> DataFrame:
    """later, earlier: ordered pairs of different titles alike, among ``titles`` (title, period) of one period or the next.

    A period's titles are dealt by length into blocks; blocks that may hold titles near in length meet, and the bits that
    marks share bound the runs of three that each title has in common with each. What has enough is matched. All pairs of
    a period and the next are so compared: cheap, and in strips of blocks, but as many as the square of its titles.
    """
    if alike < 0.8:
        raise ValueError("a ratio below 0.8 leaves too few common runs to search by")
    cells = titles.where(F.length("title") >= 3).select("title", "period").distinct().withColumn("mark", _mark("title"))
    turn = F.row_number().over(Window.partitionBy("period").orderBy(F.length("title"), "title"))
    dealt = cells.withColumn("block", F.floor((turn - 1) / BLOCK))
    blocks = cut(dealt.groupBy("period", "block").agg(F.collect_list(F.struct("title", "mark")).alias("titles"), F.min(F.length("title")).alias("low"), F.max(F.length("title")).alias("high")))
    own = blocks.select("period", F.col("block").alias("a"), F.col("titles").alias("one"), F.col("low").alias("low1"), F.col("high").alias("high1"))
    near = blocks.select(F.explode(F.array(F.col("period"), F.col("period") + 1)).alias("period"), F.col("period").alias("its"), F.col("block").alias("b"), F.col("titles").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    least = alike / (2 - alike)
    reach = (F.col("high1") >= least * F.col("low2") - 1e-9) & (F.col("high2") >= least * F.col("low1") - 1e-9)
    once = (F.col("its") != F.col("period")) | (F.col("a") <= F.col("b"))
    same = (F.col("its") == F.col("period")) & (F.col("a") == F.col("b"))
    met = own.join(near, "period").where(reach & once).select("one", "other", same.alias("same"))
    # a task's pairs of blocks are read together, so there are few
    tiles = met.repartition(max(TASKS, met.count() // TILES))
    likely = tiles.mapInArrow(_likely(alike), "one string, other string").distinct().repartition(TASKS)
    both = likely.select(F.explode(F.array(F.struct(F.col("one").alias("later"), F.col("other").alias("earlier")), F.struct(F.col("other").alias("later"), F.col("one").alias("earlier")))).alias("p")).select("p.*")
    return both.where(matching_ratio("later", "earlier") >= alike)


def _clean(items: DataFrame, hours: int) -> DataFrame:
    seconds = F.unix_micros(F.col("published").cast("timestamp"))
    return items.select(
        "item_id", F.coalesce(canonical_url(F.col("url")), F.lit("")).alias("url"), F.coalesce(normalised_title(F.col("title"), F.col("source")), F.lit("")).alias("title"),
        seconds.alias("at"), F.floor(seconds / (hours * 3_600_000_000)).cast("long").alias("period"), F.coalesce("kind", F.lit("")).alias("kind"), "security_id", "source",
    )


def _not_stored(items: DataFrame, stored: DataFrame, similar: DataFrame, hours: int) -> DataFrame:
    """Items that are the same as no stored one. Stored times are reduced to the first and last of a title and period."""
    fresh = items.join(stored.where("url <> ''").select("url").distinct(), "url", "left_anti")
    span = stored.where("title <> ''").groupBy(F.col("title").alias("earlier"), "period", F.col("kind").alias("its_kind"), F.col("security_id").alias("its_security")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    span = span.withColumn("period", F.explode(F.array(F.col("period") - 1, F.col("period"), F.col("period") + 1)))
    twins = similar.union(items.where("title <> ''").select("title", "title").distinct()).toDF("title", "earlier")
    window = hours * 3_600_000_000
    near = (F.col("first") <= F.col("at") + window) & (F.col("last") >= F.col("at") - window)
    told = (F.col("kind") != ANNOUNCEMENT) & (F.col("its_kind") != ANNOUNCEMENT) | F.coalesce(F.col("security_id") == F.col("its_security"), F.lit(False))
    gone = fresh.join(twins, "title").join(span, ["earlier", "period"]).where(near & told).select("item_id").distinct()
    return fresh.join(gone, "item_id", "left_anti")


def _in_order(window: int):
    """The greedy pass: rows come by story and time; a story's kept items are held for ``window``, its addresses for good."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        story = None
        by_url: dict[str, int] = {}
        by_title: dict[str, list[tuple[int, int, str, object]]] = defaultdict(list)
        turn: dict[int, int] = {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.story != story:
                    story, by_url, by_title, turn = row.story, {}, defaultdict(list), {}
                security = None if pd.isna(row.security_id) else row.security_id
                found = [by_url[row.url]] if row.url and row.url in by_url else []
                for title in ([row.title, *row.twins] if row.title else []):
                    recent = by_title.get(title)
                    if recent:
                        recent[:] = [k for k in recent if row.at - k[0] <= window]
                        found += [i for _, i, kind, its in recent if ANNOUNCEMENT not in (row.kind, kind) or security is not None and security == its]
                if found:
                    out.append((row.item_id, min(found, key=turn.__getitem__)))
                    continue
                turn[row.item_id] = len(turn)
                if row.url:
                    by_url[row.url] = row.item_id
                if row.title:
                    by_title[row.title].append((row.at, row.item_id, row.kind, security))
                out.append((row.item_id, row.item_id))
            yield pd.DataFrame(out, columns=["item_id", "kept_id"]).astype("int64")

    return run


def dedupe_news(items: DataFrame, stored: DataFrame | None = None, alike: float = ALIKE, hours: int = HOURS) -> DataFrame:
    """item_id (of the first item of each new story), also (other sources that carried it, sorted), folded (items that went).

    ``items``: item_id (unique long), title, url, published, source, security_id, kind. Two are the same if their
    canonical addresses are equal, or if their titles are alike, they were published within ``hours``, and neither is an
    announcement or both are about one security. Items are taken in order of time (then item_id); one that is the same as
    a stored item goes, one that is the same as a kept one is folded into the first such, any other is kept.

    Only titles of one period or the next are compared. Titles and periods that are linked make a story; each story
    passes one task as a stream sorted by time, which holds the kept items of the last ``hours`` and the addresses. Null
    and empty titles match by address only; items without a time of publication are left out.
    """
    fresh = _clean(items.where(F.col("published").isNotNull()), hours)
    known = None if stored is None else _clean(stored.where(F.col("published").isNotNull()), hours)
    every = fresh if known is None else fresh.unionByName(known)
    similar = cut(similar_titles(every.where("title <> ''").select("title", "period"), alike))
    if known is not None:
        fresh = _not_stored(fresh, known, similar, hours)
    # a title in a period is a cell; without a title, an address or else the item alone
    cell = F.when(F.col("title") != "", F.xxhash64("title", "period")).when(F.col("url") != "", F.xxhash64(F.lit("\0url"), "url")).otherwise(F.xxhash64(F.lit("\0item"), "item_id"))
    fresh = fresh.withColumn("cell", cell)
    cells = fresh.where("title <> ''").select("title", "period", "cell").distinct()
    twins = similar.select(F.col("later").alias("title"), F.col("earlier").alias("other")).union(cells.select("title", "title"))
    steps = cells.join(twins, "title").select("cell", F.col("other").alias("title"), F.explode(F.array(F.col("period"), F.col("period") + 1, F.col("period") - 1)).alias("period"))
    by_title = steps.join(cells.withColumnRenamed("cell", "b"), ["title", "period"]).select(F.col("cell").alias("a"), "b")
    first = fresh.where("url <> ''").groupBy("url").agg(F.min("cell").alias("b"))
    by_url = fresh.where("url <> ''").select("url", "cell").distinct().join(first, "url").select(F.col("cell").alias("a"), "b")
    story = groups(by_title.union(by_url).union(fresh.where("url = '' and title = ''").select("cell", "cell"))).select(F.col("node").alias("cell"), F.col("group").alias("story"))
    others = similar.groupBy(F.col("later").alias("title")).agg(F.sort_array(F.collect_set("earlier")).alias("twins"))
    ready = fresh.join(story, "cell").join(others, "title", "left").withColumn("twins", F.coalesce("twins", F.array().cast("array<string>")))
    ordered = ready.select("story", "at", "item_id", "url", "title", "kind", "security_id", "twins").repartition("story").sortWithinPartitions("story", "at", "item_id")
    folded = ordered.mapInPandas(_in_order(hours * 3_600_000_000), "item_id long, kept_id long")
    source = fresh.select("item_id", "source")
    carried = folded.join(source, "item_id").join(source.select(F.col("item_id").alias("kept_id"), F.col("source").alias("own")), "kept_id")
    other = F.when(~F.col("source").eqNullSafe(F.col("own")), F.col("source"))
    return carried.groupBy(F.col("kept_id").alias("item_id")).agg(F.sort_array(F.collect_set(other)).alias("also"), (F.count("*") - 1).alias("folded"))
