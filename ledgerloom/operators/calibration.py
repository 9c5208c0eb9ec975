"""Hit rates by conviction with bootstrap intervals, and whether they fall from high to low."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.checkpoints import cut

CONVICTIONS = ["high", "medium", "low"]
#: The shifts of the 64-bit generator: left, right, left.
SHIFTS = (13, 7, 17)
#: Tasks that share a conviction's resamples, states that step together, and numbers that a task holds.
LANES, WIDTH, HELD = 8, 8192, 16_000_000


def advance(states: np.ndarray) -> np.ndarray:
    """The next state of each generator."""
    left, right, last = (np.uint64(s) for s in SHIFTS)
    states = states ^ (states << left)
    states = states ^ (states >> right)
    return states ^ (states << last)


def _columns_after(steps: int) -> np.ndarray:
    """What each single bit becomes after so many steps: a step is linear over bits, so powers of it are by squaring."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    power, out = advance(bits), bits.copy()
    while steps:
        if steps & 1:
            out = _apply(power, out)
        power = _apply(power, power)
        steps >>= 1
    return out


def _apply(columns: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for bit in range(64):
        out ^= np.where((states >> np.uint64(bit)) & np.uint64(1), columns[bit], np.uint64(0))
    return out


def bootstrap_interval(values: np.ndarray, resamples: int, seed: int, level: int = 90) -> tuple[float, float]:
    """The interval of the mean over ``resamples`` draws with replacement from one stream of states.

    Resample r begins ``r * n`` states on. All of them step together, so a bucket costs n array operations.
    """
    if seed <= 0 or resamples < 1 or not 0 < level < 100 or not len(values):
        raise ValueError("a positive seed, a resample, a level between 1 and 99 and a value are needed")
    n = len(values)
    jump, filled = _columns_after(n), 1
    lanes = np.full(resamples, seed, dtype=np.uint64)
    while filled < resamples:
        more = min(filled, resamples - filled)
        lanes[filled : filled + more] = _apply(jump, lanes[:more])
        jump, filled = _apply(jump, jump), filled + more
    totals = np.zeros(resamples)
    for _ in range(n):
        lanes = advance(lanes)
        totals += values[lanes % np.uint64(n)]
    means = np.sort(totals / n)
    low, high = (100 - level) * resamples // 200, ((100 + level) * resamples + 199) // 200 - 1
    return float(means[low]), float(means[min(high, resamples - 1)])


def resample_totals(values: np.ndarray, base: int, n: int, first: int, last: int, seed: int) -> np.ndarray:
    """What the draws of resamples ``first`` to ``last`` (excluded) add up to, of the values at places ``base`` on of ``n``.

    A resample's states are cut into runs that step together, so that arrays stay long with few resamples.
    """
    count = last - first
    runs = max(1, min(WIDTH // count, n // 64))
    steps = n // runs

    def begin(at: np.ndarray, jump: np.ndarray, many: int) -> np.ndarray:
        """``many`` states for each of ``at``, one jump after another."""
        lanes, filled = np.repeat(at[..., None], many, -1), 1
        while filled < many:
            more = min(filled, many - filled)
            lanes[..., filled : filled + more] = _apply(jump, lanes[..., :more])
            jump, filled = _apply(jump, jump), filled + more
        return lanes

    start = _apply(_columns_after(first * n), np.array([seed], dtype=np.uint64))
    starts = begin(start, _columns_after(n), count)[0]
    size, low, whole = np.uint64(n), np.int64(base), len(values) == n

    def drawn(lanes: np.ndarray, turns: int) -> np.ndarray:
        sums = np.zeros(lanes.shape)
        for _ in range(turns):
            lanes = advance(lanes)
            places = (lanes % size).view(np.int64)
            if whole:
                sums += values[places]
            else:
                places = places - low
                inside = (places >= 0) & (places < len(values))
                sums[inside] += values[places[inside]]
        return sums

    totals = drawn(begin(starts, _columns_after(steps), runs), steps).sum(-1)
    return totals + drawn(_apply(_columns_after(steps * runs), starts), n - steps * runs)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's numbers of each conviction, in order, as bytes; ``part`` and ``turn`` tell the place of a batch."""
    part = TaskContext.get().partitionId()
    for turn, batch in enumerate(batches):
        level = batch["conviction"].to_numpy(zero_copy_only=False)
        numbers = {name: batch[name].to_numpy(zero_copy_only=False).astype(float) for name in ("hit", "excess")}
        rows = []
        for conviction in dict.fromkeys(level):
            for name, values in numbers.items():
                own = values[level == conviction]
                own = own[~np.isnan(own)] if name == "excess" else own * 100
                if len(own):
                    rows.append({"conviction": conviction, "series": name, "part": part, "turn": turn, "n": len(own), "total": float(own.sum()), "bytes": own.astype("<f8").tobytes()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("conviction", pa.string()), ("series", pa.string()), ("part", pa.int32()), ("turn", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("bytes", pa.binary())]))


def _drawn(resamples: int, seed: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conviction, series, lanes, _ = (k.as_py() for k in key)
        pieces = sorted((start, n, data) for b in batches for start, n, data in zip(*(b[c].to_pylist() for c in ("start", "all", "bytes"))))
        first, last = (resamples * k // LANES for k in (lanes, lanes + 1))
        if first == last:
            return
        totals = resample_totals(np.concatenate([np.frombuffer(p[2], "<f8") for p in pieces]), pieces[0][0], pieces[0][1], first, last, seed)
        yield pa.RecordBatch.from_pydict({"conviction": [conviction] * len(totals), "series": [series] * len(totals), "resample": np.arange(first, last), "total": totals})

    return run


def buckets(calls: DataFrame, resamples: int = 1000, seed: int = 20260101, level: int = 90) -> DataFrame:
    """From (conviction, hit, call_excess, call_id): n, hit_pct and its interval, mean_excess and its interval.

    Calls without a hit are left out. Resamples are dealt to tasks, as any place of the stream of states can be reached
    by a jump; each holds the numbers of one conviction, eight bytes a call, or ``HELD`` of them at a time: of more
    calls, several tasks draw the same states and add up what falls into their part.
    """
    if seed <= 0 or resamples < 1 or not 0 < level < 100:
        raise ValueError("a positive seed, a resample and a level between 1 and 99 are needed")
    eligible = calls.where(F.col("hit").isNotNull() & F.col("conviction").isin(*CONVICTIONS)).select("conviction", "call_id", F.col("hit").cast("double").alias("hit"), F.col("call_excess").cast("double").alias("excess"))
    order = ["conviction", F.col("call_id").asc_nulls_last()]
    pieces = cut(eligible.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed, "conviction string, series string, part int, turn int, n long, total double, bytes binary"))
    own = ["conviction", "series"]
    place = Window.partitionBy(*own).orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.select(*own, "part", "turn", "n")
    starts = sizes.select(*own, "part", "turn", F.coalesce(F.sum("n").over(place), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(*own)).alias("all"))
    dealt = pieces.select(*own, "part", "turn", "bytes").join(starts, [*own, "part", "turn"]).withColumn("lanes", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    held = dealt.select(*own, "lanes", F.expr(f"start div {HELD}").alias("chunk"), "start", "all", "bytes").repartition(4 * LANES * len(CONVICTIONS), *own, "lanes", "chunk")
    totals = held.groupBy(*own, "lanes", "chunk").applyInArrow(_drawn(resamples, seed), "conviction string, series string, resample long, total double")
    summed = totals.groupBy(*own, "resample").agg(F.sum("total").alias("total")).groupBy(*own).agg(F.sort_array(F.collect_list("total")).alias("totals"))
    low, high = (100 - level) * resamples // 200, min(((100 + level) * resamples + 199) // 200 - 1, resamples - 1)
    # pieces are added in order, so reruns agree
    parts = pieces.groupBy(*own).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "turn", "total"))).alias("parts"))
    measured = parts.join(summed, own).select(
        *own, "n", (F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["total"]) / F.col("n")).alias("mean"),
        *[(F.get("totals", F.lit(k)) / F.col("n")).alias(name) for name, k in (("low", low), ("high", high))],
    )
    side = lambda name: measured.where(F.col("series") == name)
    hits = side("hit").select("conviction", "n", F.col("mean").alias("hit_pct"), F.col("low").alias("hit_low"), F.col("high").alias("hit_high"))
    excess = side("excess").select("conviction", F.col("mean").alias("mean_excess"), F.col("low").alias("excess_low"), F.col("high").alias("excess_high"))
    return hits.join(excess, "conviction", "left")


def verdict(measured: DataFrame, least: int = 40) -> DataFrame:
    """One row: n and the verdict over at most three buckets.

    monotonic if each hit rate is above the next and their intervals are apart; not monotonic if a rise has its
    intervals apart; inconclusive otherwise, and not enough data below ``least`` calls.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in CONVICTIONS]), F.col("conviction"))
    following = Window.orderBy(place)  # three rows at most
    pair = measured.select("n", "hit_pct", "hit_low", "hit_high", F.lead("hit_pct").over(following).alias("pct"), F.lead("hit_low").over(following).alias("low"), F.lead("hit_high").over(following).alias("high"))
    apart: Column = (F.col("hit_low") > F.col("high")) | (F.col("low") > F.col("hit_high"))
    rises = F.col("hit_pct") < F.col("pct")
    counts = pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count("pct").alias("pairs"),
        F.count(F.when(rises, 1)).alias("rises"),
        F.count(F.when(rises & apart, 1)).alias("clear_rises"),
        F.count(F.when(~apart, 1)).alias("overlaps"),
    )
    told = F.when(F.col("n") < least, "not enough data").when(F.col("pairs") < 1, "inconclusive").when(F.col("clear_rises") > 0, "not monotonic").when((F.col("rises") > 0) | (F.col("overlaps") > 0), "inconclusive").otherwise("monotonic")
    return counts.select("n", told.alias("verdict"))
