"""Which securities may be looked at: liquidity, exclusions, size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_value(bars: DataFrame, days: int = 20, scale: float = 1.0) -> DataFrame:
    """security_id, last_bar, adv: mean volume of the last ``days`` bars times the last close; null if one has no volume or there are fewer."""
    recent = bars.withColumn("__k", F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("date")))).where(F.col("__k") <= days)
    seen = recent.groupBy("security_id").agg(F.max("date").alias("last_bar"), F.max_by("close", "date").alias("close"), F.avg("volume").alias("mean"), F.count("volume").alias("n"))
    return seen.select("security_id", "last_bar", F.when(F.col("n") == days, F.col("mean") * F.col("close") * scale).alias("adv"))


def removal(adv: Column, last_bar: Column, as_of: Column, floor: Column, max_age: Column, excluded: Column) -> Column:
    """The one reason why a security goes, or null; a value at the floor stays."""
    stale = F.datediff(as_of, last_bar) > max_age
    return F.when(excluded, "excluded").when(adv.isNull() | last_bar.isNull(), "insufficient liquidity data").when(stale, "last bar is too old").when(adv < floor, "below the liquidity floor")


def names_excluded(exclusions: Sequence[str], *fields: Column) -> Column:
    """Whether any field is, as whole text without regard to case, one of the exclusions."""
    wanted = [x.strip().lower() for x in exclusions]
    return F.coalesce(F.exists(F.array(*[F.lower(f) for f in fields]), lambda f: f.isin(*wanted)), F.lit(False))


def cap_bucket(cap: Column, large: float, mid: float) -> Column:
    return F.when(cap.isNull(), "unclassified").when(cap >= large, "large").when(cap >= mid, "mid").otherwise("small")


def currency_exposure(rows: DataFrame, home: str = "INR") -> DataFrame:
    """portfolio, currency, value, pct from (portfolio, currency, value), with value null where no rate is known.

    A currency with such a row has no value, and then no currency of the portfolio has a share. Portfolios in the home
    currency alone aren't listed.
    """
    sums = rows.groupBy("portfolio", "currency").agg(F.sum("value").alias("value"), F.count(F.when(F.col("value").isNull(), 1)).alias("unknown"))
    own = Window.partitionBy("portfolio")
    seen = sums.withColumns({"foreign": F.max((F.col("currency") != home).cast("int")).over(own), "gaps": F.sum("unknown").over(own), "total": F.sum("value").over(own)}).where("foreign = 1")
    value = F.when(F.col("unknown") == 0, F.col("value"))
    return seen.select("portfolio", "currency", value.alias("value"), F.when((F.col("gaps") == 0) & (F.col("total") > 0), 100 * F.col("value") / F.col("total")).alias("pct"))


def history_compare(months: DataFrame, current: DataFrame, stretch: float = 1.25, window: int = 36, least: int = 24) -> DataFrame:
    """fund, months, median, ratio, label (expensive, cheap, in range) of the current multiple against the last month ends.

    ``months`` is (fund, month, multiple), ``current`` (fund, current). Only positive multiples count.
    """
    recent = months.withColumn("__k", F.row_number().over(Window.partitionBy("fund").orderBy(F.desc("month")))).where((F.col("__k") <= window) & (F.col("multiple") > 0))
    seen = recent.groupBy("fund").agg(F.count("*").alias("months"), F.median("multiple").alias("m"))
    both = current.join(seen, "fund", "left").withColumn("median", F.when(F.col("months") >= least, F.col("m")))
    ratio = F.when(F.col("current") > 0, F.bround(F.col("current") / F.col("median"), 4))
    label = F.when(F.col("ratio") > stretch, "expensive").when(F.col("ratio") * stretch < 1, "cheap").when(F.col("ratio").isNotNull(), "in range")
    return both.withColumn("ratio", ratio).select("fund", F.coalesce("months", F.lit(0)).alias("months"), "median", "ratio", label.alias("label"))
