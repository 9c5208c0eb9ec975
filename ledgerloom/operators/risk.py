"""Risk of fixed-weight portfolios: deviation, path drawdown, days to trade, and a candidate put in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import ratio


def shared_path(bars: DataFrame, holdings: DataFrame) -> DataFrame:
    """portfolio, date, ret: the weighted return between sessions on which every holding has a close.

    ``holdings`` is (portfolio, security_id, weight), a security once in each. With fixed weights the deviation of
    this path is that of the covariance form, without a row for each pair.
    """
    size = holdings.groupBy("portfolio").agg(F.count("*").alias("__size"))
    closes = bars.where("close is not null").select("security_id", "date", "close").join(holdings, "security_id")
    counted = closes.withColumn("__n", F.count("*").over(Window.partitionBy("portfolio", "date")))
    whole = counted.join(size, "portfolio").where(F.col("__n") == F.col("__size"))
    before = F.lag("close").over(Window.partitionBy("portfolio", "security_id").orderBy("date"))
    moved = whole.withColumn("__ret", F.col("weight") * (ratio(F.col("close"), before) - 1)).where("__ret is not null")
    return moved.groupBy("portfolio", "date").agg(F.sum("__ret").alias("ret"))


def _latest(path: DataFrame, n: int) -> DataFrame:
    return path.withColumn("__k", F.row_number().over(Window.partitionBy("portfolio").orderBy(F.desc("date")))).where(F.col("__k") <= n).drop("__k")


def volatility(path: DataFrame, lookback: int = 252, least: int = 60, year: int = 252) -> DataFrame:
    """portfolio, days, volatility (a fraction a year; null for fewer than ``least`` returns)."""
    found = _latest(path, lookback).groupBy("portfolio").agg(F.count("*").alias("days"), F.stddev_samp("ret").alias("sd"))
    return found.select("portfolio", "days", F.when(F.col("days") >= least, F.col("sd") * year**0.5).alias("volatility"))


def path_drawdown(path: DataFrame, sessions: int) -> DataFrame:
    """portfolio, days, drawdown_pct of the level that the last ``sessions`` returns build from 1; null for fewer.

    Levels are running sums of logarithms, so returns must be above -1, as those of positive closes and weights are.
    """
    so_far = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    level = _latest(path, sessions).withColumn("__level", F.exp(F.sum(F.log1p("ret")).over(so_far)))
    fall = level.withColumn("__peak", F.greatest(F.lit(1.0), F.max("__level").over(so_far))).withColumn("__fall", (F.col("__peak") - F.col("__level")) / F.col("__peak"))
    found = fall.groupBy("portfolio").agg(F.count("*").alias("days"), F.max("__fall").alias("worst"))
    return found.select("portfolio", "days", F.when(F.col("days") >= sessions, 100 * F.greatest(F.lit(0.0), F.col("worst"))).alias("drawdown_pct"))


def days_to_trade(size: Column, adv_value: Column, participation_pct: float = 10.0) -> Column:
    """Sessions to trade ``size`` at a share of the mean daily value; null without any."""
    return F.when(adv_value > 0, size / (participation_pct / 100 * adv_value))


def pro_forma(held: DataFrame, candidates: DataFrame, max_position: float, max_sector: float) -> DataFrame:
    """What a candidate bought pro rata does: hhi, effective positions, and names and sectors over their limits.

    ``held`` is (portfolio, name, sector, value), ``candidates`` (portfolio, name, sector, weight in percent), one for
    each portfolio. Rows without a sector count as unclassified, which has no limit.
    """
    total = F.sum("value").over(Window.partitionBy("portfolio"))
    kept = held.join(candidates.select("portfolio", F.col("weight").alias("__w")), "portfolio").select("portfolio", "name", "sector", (F.col("value") / total * (100 - F.col("__w"))).alias("weight"))
    rows = kept.unionByName(candidates.select("portfolio", "name", "sector", "weight")).withColumn("sector", F.coalesce("sector", F.lit("unclassified")))
    heavy = F.array_sort(F.collect_list(F.when(F.col("weight") > max_position, F.col("name"))))  # 100 / max_position names at most
    names = rows.groupBy("portfolio").agg(F.sum(F.pow(F.col("weight") / 100, 2)).alias("hhi"), heavy.alias("names_over"))
    by_sector = rows.groupBy("portfolio", "sector").agg(F.sum("weight").alias("weight"))
    over = (F.col("weight") > max_sector) & (F.col("sector") != "unclassified")
    sectors = by_sector.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.when(over, F.col("sector")))).alias("sectors_over"))
    return names.join(sectors, "portfolio").select("portfolio", "hhi", (1 / F.col("hhi")).alias("effective"), "names_over", "sectors_over")
