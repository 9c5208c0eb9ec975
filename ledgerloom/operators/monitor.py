"""What is watched from day to day: zones, invalidation, regime, runs under an average, drawdowns, held views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import indicators as ta


def watch_distance(close: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Where the close is against an entry zone (above, below, inside, unknown), and how many percent from its edge."""
    unknown = low.isNull() | high.isNull() | close.isNull() | (low <= 0) | (high <= 0)
    side = F.when(unknown, "unknown").when(close > high, "above").when(close < low, "below").otherwise("inside")
    pct = F.when(unknown, None).when(close > high, (close - high) / high * 100).when(close < low, (close - low) / low * 100).otherwise(0.0)
    return side, pct


def entered_zone(close: Column, before: Column, low: Column, high: Column) -> Column:
    """In the zone now but not at the close before; the first close doesn't count."""
    return close.between(low, high) & before.isNotNull() & ~before.between(low, high)


def sessions_below_average(bars: DataFrame, n: int) -> DataFrame:
    """The trailing run of closes under their own ``n``-session mean; null for fewer than ``n`` closes."""
    marked = bars.withColumns({"__sma": ta.sma(n), "__at": F.row_number().over(ta.by_date())})
    last_not = F.max(F.when(F.col("__sma").isNull() | (F.col("close") >= F.col("__sma")), F.col("__at")))
    seen = marked.groupBy("security_id").agg(F.max("__at").alias("n"), F.coalesce(last_not, F.lit(0)).alias("stop"))
    return seen.select("security_id", F.when(F.col("n") >= n, F.col("n") - F.col("stop")).cast("long").alias("below"))


def max_drawdown(bars: DataFrame, lookback: int, least: int) -> DataFrame:
    """Largest fall from a running peak, in percent, over the last ``lookback`` closes; null for fewer than ``least``."""
    recent = bars.where("close is not null").withColumn("__k", F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("date")))).where(F.col("__k") <= lookback)
    peak = F.max("close").over(ta.by_date().rowsBetween(Window.unboundedPreceding, 0))
    fall = F.when(F.col("__peak") > 0, (F.col("__peak") - F.col("close")) / F.col("__peak") * 100)
    grouped = recent.withColumn("__peak", peak).groupBy("security_id").agg(F.count("*").alias("n"), F.coalesce(F.max(fall), F.lit(0.0)).alias("worst"))
    return grouped.select("security_id", F.when(F.col("n") >= least, F.bround("worst", 4)).alias("max_drawdown_pct"))


def regime(bars: DataFrame, index: DataFrame, n: int, on_pct: float, off_pct: float, least: int) -> DataFrame:
    """One row: how many securities have ``n`` closes, the percentage of them above their mean, whether the index is
    above its own (null for too few of its closes), and the regime: on or off only if both say so.

    ``index`` is a series (date, close).
    """
    last = bars.withColumns({"sma": ta.sma(n), "__k": F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("date")))}).where("__k = 1 and sma is not null")
    total = last.agg(F.count("*").alias("names"), F.sum(F.when(F.col("close") > F.col("sma"), 1).otherwise(0)).alias("above"))
    newest = index.orderBy(F.desc("date")).limit(n).agg(F.count("close").alias("n"), F.avg("close").alias("mean"), F.max_by("close", "date").alias("close"))
    above = F.when(F.col("n") == n, F.col("close") > F.col("mean"))
    one = F.lit(1).alias("one")
    both = total.select(one, "names", "above").join(newest.select(one, above.alias("index_above")), "one")
    breadth = F.when(F.col("names") > 0, F.bround(100.0 * F.col("above") / F.col("names"), 8))
    name = F.when(F.col("index_above").isNull() | (F.col("names") < least), "unavailable").when(F.col("index_above") & (breadth >= on_pct), "risk_on").when(~F.col("index_above") & (breadth <= off_pct), "risk_off").otherwise("neutral")
    return both.select("names", F.bround(breadth, 6).alias("breadth_pct"), "index_above", name.alias("regime"))


def newest_ingest(holdings: DataFrame, keys: Sequence[str], as_of: str) -> DataFrame:
    """All rows of each key's newest ingest, so that what it no longer lists is gone."""
    return holdings.withColumn("__newest", F.max(as_of).over(Window.partitionBy(*keys))).where(F.col(as_of) == F.col("__newest")).drop("__newest")


def occurrence(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identical rows numbered from 0, so that a statement's repeats are kept and a second ingest of it adds none."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) - 1)


def upsert(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows without those whose key is among the fresh ones, and the fresh ones; a key's last by all columns stays."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in fresh.columns if c not in keys]))
    return stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh.withColumn("__turn", turn).where("__turn = 1").drop("__turn"))
