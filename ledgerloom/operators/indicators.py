"""Indicators over bars (security_id, date, open, high, low, close, volume). Too few bars give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import ratio

def by_date() -> Window:
    return Window.partitionBy("security_id").orderBy("date")


def rows(n: int) -> Window:
    return by_date().rowsBetween(1 - n, 0)


def gated(value: Column, n: int, of: str = "close") -> Column:
    return F.when(F.count(of).over(rows(n)) == n, value)


def sma(n: int, of: str = "close") -> Column:
    return gated(F.avg(of).over(rows(n)), n, of)


def roc(n: int) -> Column:
    return ratio(F.col("close"), F.lag("close", n).over(by_date())) - 1


def bollinger_width(n: int, k: float) -> Column:
    return gated(ratio(2 * k * F.stddev_pop("close").over(rows(n)), F.avg("close").over(rows(n))), n)


def daily_return() -> Column:
    return ratio(F.col("close"), F.lag("close").over(by_date())) - 1


def realised_vol(returns: str, n: int, year: int = 252) -> Column:
    return F.when(F.count(returns).over(rows(n)) == n, F.stddev_samp(returns).over(rows(n)) * year**0.5)


def true_range() -> Column:
    before = F.lag("close").over(by_date())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def updown_volume(n: int) -> Column:
    """Volume of sessions that closed higher by that of sessions that closed lower, over n moves."""
    move = F.col("close") - F.lag("close").over(by_date())
    signed = F.when(move > 0, F.col("volume")).otherwise(0.0), F.when(move < 0, F.col("volume")).otherwise(0.0)
    return signed[0], signed[1]


def high_low_distance(n: int) -> tuple[Column, Column]:
    """Percent below the highest high and above the lowest low of n sessions."""
    top, bottom = F.max("high").over(rows(n)), F.min("low").over(rows(n))
    return gated(ratio(F.col("close") - top, top) * 100, n), gated(ratio(F.col("close") - bottom, bottom) * 100, n)


def series(bars: DataFrame, *columns: str) -> DataFrame:
    """A row per security with arrays in order of date: as long as its history, which is what recurrences need."""
    return bars.groupBy("security_id").agg(F.array_sort(F.collect_list(F.struct("date", *columns))).alias("s")).select("security_id", F.col("s.date").alias("dates"), *[F.col(f"s.{c}").alias(c) for c in columns])


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def ema(values: Column, n: int) -> Column:
    """The last exponential mean with weight 2 / (n + 1), begun with the mean of the first n."""
    alpha = 2.0 / (n + 1)
    rest = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(F.size(values) >= n, F.aggregate(rest, _mean(F.slice(values, 1, n)), lambda a, x: a + alpha * (x - a)))


def wilder(values: Column, n: int) -> Column:
    """The last smoothed mean: (before * (n - 1) + value) / n, begun with the mean of the first n."""
    rest = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(F.size(values) >= n, F.aggregate(rest, _mean(F.slice(values, 1, n)), lambda a, x: (a * (n - 1) + x) / n))


def _seeded(held: Column, x: Column, place: Column, n: int, then: Column) -> Column:
    """A mean in the making: a sum below the n-th value, their mean at it, and ``then`` afterwards."""
    return F.when(place < n, held + x).when(place == n, (held + x) / n).otherwise(then)


def rsi(closes: Column, n: int) -> Column:
    """Wilder's index of the last bar, in one pass; null where no close differs."""
    def step(s: Column, x: Column) -> Column:
        move, place = x - s["last"], s["place"] + 1
        up, down = F.greatest(move, F.lit(0.0)), F.greatest(-move, F.lit(0.0))
        return F.struct(
            x.alias("last"), place.alias("place"),
            _seeded(s["up"], up, place, n, (s["up"] * (n - 1) + up) / n).alias("up"), _seeded(s["down"], down, place, n, (s["down"] * (n - 1) + down) / n).alias("down"),
        )

    start = F.struct(F.get(closes, F.lit(0)).alias("last"), F.lit(0).alias("place"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))
    rest = F.slice(closes, 2, F.greatest(F.size(closes), F.lit(0)))
    return F.aggregate(rest, start, step, lambda s: F.when((s["place"] >= n) & (s["up"] + s["down"] > 0), 100.0 * s["up"] / (s["up"] + s["down"])))


def macd(closes: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """A struct of line and signal of the last bar, in one pass; each mean begins with its own first bars."""
    def step(s: Column, x: Column) -> Column:
        place = s["place"] + 1
        quick = _seeded(s["quick"], x, place, fast, s["quick"] + 2.0 / (fast + 1) * (x - s["quick"]))
        late = _seeded(s["late"], x, place, slow, s["late"] + 2.0 / (slow + 1) * (x - s["late"]))
        return F.struct(place.alias("place"), quick.alias("quick"), late.alias("late"), s["signal"].alias("signal"))

    def follow(s: Column, x: Column) -> Column:
        now = step(s, x)
        line, n = now["quick"] - now["late"], now["place"] - slow + 1
        held = F.when(n >= 1, _seeded(s["signal"], line, n, signal, s["signal"] + 2.0 / (signal + 1) * (line - s["signal"]))).otherwise(0.0)
        return F.struct(now["place"].alias("place"), now["quick"].alias("quick"), now["late"].alias("late"), held.alias("signal"))

    start = F.struct(F.lit(0).alias("place"), *[F.lit(0.0).alias(c) for c in ("quick", "late", "signal")])
    enough = slow + signal - 1
    return F.aggregate(closes, start, follow, lambda s: F.when(s["place"] >= enough, F.struct((s["quick"] - s["late"]).alias("line"), s["signal"].alias("signal"))))


def weekly_closes(bars: DataFrame) -> DataFrame:
    """The last close of each ISO week."""
    week = F.trunc("date", "week")
    return bars.groupBy("security_id", week.alias("week")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


def swing_pivots(w: int) -> tuple[Column, Column]:
    """Whether a bar is the first highest high, and the first lowest low, of the w bars on either side."""
    around, before = by_date().rowsBetween(-w, w), by_date().rowsBetween(-w, -1)
    whole = F.count("*").over(around) == 2 * w + 1
    return whole & (F.max("high").over(around) == F.col("high")) & (F.max("high").over(before) < F.col("high")), whole & (F.min("low").over(around) == F.col("low")) & (F.min("low").over(before) > F.col("low"))


def gap_zones(bars: DataFrame, least_pct: float) -> DataFrame:
    """Gaps of at least so many percent that no later bar has filled: side, from, to. From a price of zero there is none."""
    later = by_date().rowsBetween(1, Window.unboundedFollowing)
    seen = bars.select("security_id", "date", F.lag("high").over(by_date()).alias("high_before"), F.lag("low").over(by_date()).alias("low_before"), "high", "low", F.min("low").over(later).alias("later_low"), F.max("high").over(later).alias("later_high"))
    up = F.coalesce(ratio(F.col("low") - F.col("high_before"), F.col("high_before")) * 100 >= least_pct, F.lit(False))
    down = F.coalesce(ratio(F.col("low_before") - F.col("high"), F.col("low_before")) * 100 >= least_pct, F.lit(False))
    open_up = up & F.coalesce(F.col("later_low") > F.col("high_before"), F.lit(True))
    open_down = down & F.coalesce(F.col("later_high") < F.col("low_before"), F.lit(True))
    side = F.when(open_up, "up").when(open_down, "down")
    return seen.select("security_id", "date", side.alias("side"), F.when(open_up, F.col("high_before")).otherwise(F.col("high")).alias("low_edge"), F.when(open_up, F.col("low")).otherwise(F.col("low_before")).alias("high_edge")).where("side is not null")


def big_moves(bars: DataFrame, times: float = 2.0, n: int = 20) -> DataFrame:
    """Moves beyond so many sample deviations of the n moves before; a flat baseline gives none."""
    moved = bars.withColumn("move", daily_return())
    before = by_date().rowsBetween(-n, -1)
    limits = moved.select("security_id", "date", "move", F.stddev_samp("move").over(before).alias("sd"), F.count("move").over(before).alias("n"))
    return limits.where((F.col("n") == n) & (F.col("sd") > 0) & (F.abs("move") > times * F.col("sd"))).select("security_id", "date", "move", "sd")


def breaks(bars: DataFrame, n: int = 252, volume_times: float = 2.5, volume_n: int = 20) -> DataFrame:
    """Closes beyond the range of the n sessions before, on volume above a multiple of the mean."""
    before, recent = by_date().rowsBetween(-n, -1), by_date().rowsBetween(-volume_n, -1)
    seen = bars.select("security_id", "date", "close", "volume", F.max("high").over(before).alias("top"), F.min("low").over(before).alias("bottom"), F.count("*").over(before).alias("n"), F.avg("volume").over(recent).alias("usual"))
    side = F.when(F.col("close") > F.col("top"), "high").when(F.col("close") < F.col("bottom"), "low")
    return seen.withColumn("side", side).where((F.col("n") == n) & F.col("side").isNotNull() & (F.col("volume") > volume_times * F.col("usual"))).select("security_id", "date", "side", "close", "volume")


def all_cells(bars: DataFrame, benchmark: DataFrame, sector: DataFrame) -> DataFrame:
    """The 27 cells of each security's last bar, null where there are too few bars or the figure is undefined.

    ``benchmark`` is (date, benchmark), ``sector`` (security_id, date, sector_close). Windows, recurrences and ratios
    are three branches over the same partitioning; columns that aren't selected later are pruned with their work.
    """
    up, down = updown_volume(20)
    top, bottom = high_low_distance(252)
    first = bars.withColumns({"__ret": daily_return(), "__up": up, "__down": down, "__sma50": sma(50)})
    cells = {
        "n_bars": F.count("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0)),
        "sma_20": sma(20), "sma_50": F.col("__sma50"), "sma_200": sma(200),
        "slope_50dma_pct": 100 * (ratio(F.col("__sma50"), F.lag("__sma50", 20).over(by_date())) - 1),
        "price_vs_sma200_pct": 100 * (ratio(F.col("close"), sma(200)) - 1),
        "roc_3m": roc(63), "roc_6m": roc(126), "roc_12m": roc(252), "dist_52w_high_pct": top, "dist_52w_low_pct": bottom,
        "vol_20d": realised_vol("__ret", 20), "vol_60d": realised_vol("__ret", 60), "boll_width_20": bollinger_width(20, 2.0), "avg_volume_20": sma(20, "volume"),
        "updown_volume_ratio_20": gated(ratio(F.sum("__up").over(rows(20)), F.sum("__down").over(rows(20))), 21),
    }
    windowed = _newest(first.withColumns(cells)).select("security_id", "date", "close", *cells)
    arrays = series(bars.withColumn("tr", true_range()), "close", "tr")
    line, signal = F.col("__macd.line"), F.col("__macd.signal")
    arrays = arrays.withColumn("__macd", macd(F.col("close")))
    recurrent = arrays.select("security_id", ema(F.col("close"), 21).alias("ema_21"), rsi(F.col("close"), 14).alias("rsi_14"), line.alias("macd"), signal.alias("macd_signal"), (line - signal).alias("macd_hist"), wilder(F.filter("tr", lambda x: x.isNotNull()), 14).alias("atr_14"))
    weekly = _newest(weekly_closes(bars).withColumns({"__a": sma(10), "__b": sma(40)})).select("security_id", F.signum(F.when(F.col("__b").isNotNull(), F.col("__a") - F.col("__b"))).alias("weekly_trend"))
    against = _relative(bars.join(benchmark, "date"), "benchmark", "benchmark")
    within = _relative(bars.join(sector, ["security_id", "date"]), "sector_close", "sector")
    joined = windowed.join(recurrent, "security_id").join(weekly, "security_id")
    return joined.join(against, "security_id", "left").join(within, "security_id", "left").withColumns({"atr_pct": 100 * ratio(F.col("atr_14"), F.col("close")), "weekly_trend": F.when(F.col("n_bars") >= 200, F.col("weekly_trend"))})


def _newest(df: DataFrame) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("date")))
    return df.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def _relative(shared: DataFrame, base: str, name: str, window: int = 126) -> DataFrame:
    """Close over the base at the last shared date, and its change in percent over so many shared dates."""
    ratios = shared.withColumn("__ratio", ratio(F.col("close"), F.col(base))).where("__ratio is not null")
    moved = ratios.withColumn("__change", 100 * (ratio(F.col("__ratio"), F.lag("__ratio", window).over(by_date())) - 1))
    return _newest(moved).select("security_id", F.col("__ratio").alias(f"rs_{name}_ratio"), F.col("__change").alias(f"rs_{name}_change_6m_pct"))
