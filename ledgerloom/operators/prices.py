"""Price quality and corporate-action adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import ratio


def bar_fault() -> Column:
    """The first field that breaks a bar's rules, null for a sound bar."""
    negative = [F.when(F.col(c) < 0, f"{c} negative") for c in ("open", "high", "low", "close", "volume")]
    outside = [F.when((F.col(c) < F.col("low")) | (F.col(c) > F.col("high")), f"{c} outside range") for c in ("open", "close")]
    return F.coalesce(*negative, F.when(F.col("high") < F.col("low"), "high below low"), *outside)


def price_factors(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """The factor of each action: 1 / ratio for a split, 1 / (1 + ratio) for a bonus, (close - amount) / close for a
    dividend, by the last close before the ex-date. One action per kind and date counts, splits and boni being one kind. A split by
    zero, or a bonus that leaves no shares, has no factor."""
    kind = F.when(F.col("kind").isin("split", "bonus"), "share").otherwise(F.col("kind"))
    turn = F.row_number().over(Window.partitionBy("security_id", "ex_date", kind).orderBy("source_rank", "kind"))
    single = actions.withColumn("__turn", turn).where("__turn = 1").drop("__turn")
    dated = bars.select("security_id", "date", "close").unionByName(single.select("security_id", F.col("ex_date").alias("date"), F.lit(None).cast("double").alias("close")).distinct())
    closes = dated.withColumn("date_number", F.datediff("date", F.lit("1970-01-01"))).withColumn("before", F.last("close", ignorenulls=True).over(Window.partitionBy("security_id").orderBy("date_number").rangeBetween(Window.unboundedPreceding, -1)))
    closes = closes.groupBy("security_id", F.col("date").alias("ex_date")).agg(F.first("before", ignorenulls=True).alias("before"))
    factor = F.when(F.col("kind") == "split", ratio(F.lit(1.0), F.col("value"))).when(F.col("kind") == "bonus", ratio(F.lit(1.0), 1 + F.col("value"))).when(F.col("before") > 0, (F.col("before") - F.col("value")) / F.col("before"))
    return single.join(closes, ["security_id", "ex_date"]).select("security_id", "ex_date", "kind", factor.alias("factor"))


def cumulative_factors(factors: DataFrame) -> DataFrame:
    """Each action's date with the product of its factor and those of all later ones, by security; actions are few."""
    dated = factors.where("factor IS NOT NULL").groupBy("security_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("ex_date", "factor")))).alias("a"))
    start = F.struct(F.lit(1.0).alias("p"), F.array().cast("array<struct<ex_date:date,product:double>>").alias("out"))

    def put(a, x):
        p = a["p"] * x["factor"]
        return F.struct(p.alias("p"), F.concat(a["out"], F.array(F.struct(x["ex_date"].alias("ex_date"), p.alias("product")))).alias("out"))

    # of several actions on a day the last has the product of all
    products = dated.select("security_id", F.posexplode(F.aggregate("a", start, put, lambda a: a["out"])).alias("k", "x"))
    return products.groupBy("security_id", F.col("x.ex_date").alias("ex_date")).agg(F.max_by("x.product", "k").alias("product"))


def adjusted_closes(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """close times the product of the factors of all later actions.

    Products are made over actions alone; a bar takes that of the next action after it, from one running window
    backwards in time over both.
    """
    events = bars.select("security_id", "date", "close", F.lit(None).cast("double").alias("product")).unionByName(cumulative_factors(factors).select("security_id", F.col("ex_date").alias("date"), F.lit(None).cast("double").alias("close"), "product"))
    later = Window.partitionBy("security_id").orderBy(-F.datediff("date", F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("multiplier", F.coalesce(F.last("product", ignorenulls=True).over(later), F.lit(1.0)))
    return marked.where("close is not null").select("security_id", "date", "close", "multiplier", F.bround(F.col("close") * F.col("multiplier"), 6).alias("adj_close"))


def cross_source(primary: DataFrame, secondary: DataFrame, tolerance: float) -> DataFrame:
    """Each primary close against the secondary's: ok, mismatch, or single_source."""
    other = secondary.select("security_id", "date", F.col("close").alias("other"))
    state = F.when(F.col("other").isNull(), "single_source").when(F.abs(F.col("close") - F.col("other")) <= tolerance * F.abs("other"), "ok").otherwise("mismatch")
    return primary.join(other, ["security_id", "date"], "left").select("security_id", "date", "close", "other", state.alias("state"))


def missing_weekdays(points: DataFrame, limit: int, key: str = "security_id") -> DataFrame:
    """Runs of more than ``limit`` weekdays between two dates of a series: gap_from, gap_to, days."""
    after = F.lead("date").over(Window.partitionBy(key).orderBy("date"))
    inside = F.filter(F.sequence(F.date_add("date", 1), F.date_sub("after", 1)), lambda d: F.dayofweek(d).between(2, 6))
    gaps = points.withColumn("after", after).where(F.datediff("after", "date") > 1).withColumn("days", inside).where(F.size("days") > limit)
    return gaps.select(key, F.array_min("days").alias("gap_from"), F.array_max("days").alias("gap_to"), F.size("days").alias("days"))
