"""Calls and their scores: measurement, folding of repeats, scorecards, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.graph import chain_ends
from ledgerloom.operators.pit import asof_join


#: Days by which the bar of a call's entry may precede it.
ENTRY_DAYS = 5
GAIN, AVOID = ("BUY", "ACCUMULATE"), ("SELL", "TRIM", "AVOID")


def filled(series: DataFrame, value: str) -> DataFrame:
    """``value`` of a series (date, value) on every day from its first to its last date, with the date it is of."""
    after = F.lead("date").over(Window.orderBy("date"))
    days = F.sequence("date", F.coalesce(F.date_sub(after, 1), F.col("date")))
    return series.select(F.col("date").alias("of"), F.col(value).alias("level"), days.alias("days")).select("of", "level", F.explode("days").alias("day"))


def score_calls(calls: DataFrame, prices: DataFrame, benchmark: DataFrame, weeks: int, today: str, cost_pct: float, stale_days: int) -> DataFrame:
    """Each call's return to the last close on or before its target date: pending, insufficient or scored.

    ``calls``: call_id, security_id, date, verdict and perhaps price_date; ``prices``: security_id, date, close;
    ``benchmark``: date, benchmark. The entry is the bar of price_date if there is one, else the last within
    ``ENTRY_DAYS``. Both series must reach the target. The excess of a buy is less cost, a sell's has the other sign and
    none, a hold has none. What can't be measured is pending until ``stale_days`` after the target.
    """
    given = F.col("price_date") if "price_date" in calls.columns else F.lit(None).cast("date")
    dated = calls.withColumns({"target": F.date_add("date", 7 * weeks), "__given": given, "__at": F.coalesce(given, F.col("date"))})
    entry = asof_join(dated, prices, ["security_id"], "__at", "date", ["close"]).withColumnsRenamed({"asof_date": "entry_date", "asof_close": "entry"})
    end = asof_join(entry, prices, ["security_id"], "target", "date", ["close"])
    last = prices.groupBy("security_id").agg(F.max("date").alias("last"))
    levels = filled(benchmark, "benchmark")
    named = lambda day, name: levels.select(F.col("day").alias(day), F.col("of").alias(f"{name}_of"), F.col("level").alias(name))
    joined = end.join(last, "security_id", "left").join(named("entry_date", "b0"), "entry_date", "left").join(named("target", "b1"), "target", "left")
    near = F.when(F.col("__given").isNotNull(), F.col("entry_date") == F.col("__given")).otherwise(F.datediff("date", "entry_date") <= ENTRY_DAYS)
    fresh = (F.datediff("target", "asof_date") <= stale_days) & (F.datediff("target", "b1_of") <= stale_days)
    known = near & (F.datediff("entry_date", "b0_of") <= ENTRY_DAYS) & (F.col("last") >= F.col("target")) & fresh & (F.col("entry") > 0) & (F.col("b0") > 0)
    late = F.lit(today).cast("date") >= F.date_add("target", stale_days)
    status = F.when(F.col("verdict") == "INSUFFICIENT_DATA", "insufficient").when(F.coalesce(known, F.lit(False)), "scored").when(late, "insufficient").otherwise("pending")
    percent = lambda b, a: F.when(F.col("status") == "scored", F.bround(100 * (F.col(b) / F.col(a) - 1), 4))
    measured = joined.withColumn("status", status).withColumns({"ret": percent("asof_close", "entry"), "benchmark": percent("b1", "b0")})
    gain, avoid = F.col("verdict").isin(*GAIN), F.col("verdict").isin(*AVOID)
    excess = F.bround(F.when(gain, F.col("ret") - F.col("benchmark") - cost_pct).when(avoid, F.col("benchmark") - F.col("ret")), 4)
    return measured.withColumn("call_excess", excess).select("call_id", "security_id", "verdict", "status", "ret", "benchmark", "call_excess", (F.col("call_excess") > 0).alias("hit"))


def scorecard(scores: DataFrame, dimensions: Sequence[str], enough: int) -> DataFrame:
    """Calls, scored calls, hit rate, mean and median excess and the worst one for each member of each dimension.

    Every call is a row of each of its members; ``scores`` has one row for each call at a horizon.
    """
    member = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in dimensions]))
    rows = scores.select("call_id", "status", "hit", "call_excess", member.alias("m")).select("m.*", "call_id", "status", "hit", "call_excess")
    # one row for each call and member: then counts need no distinct
    calls = rows.groupBy("dimension", "member", "call_id").agg(F.max((F.col("status") == "scored").cast("int")).alias("scored"), F.collect_list(F.struct("hit", "call_excess")).alias("values"))
    each = calls.withColumn("v", F.explode_outer("values")).withColumn("first", F.row_number().over(Window.partitionBy("dimension", "member", "call_id").orderBy("v.call_excess")) == 1)
    once = lambda c: F.sum(F.when(F.col("first"), c).otherwise(0))
    return each.groupBy("dimension", "member").agg(
        once(F.lit(1)).alias("calls"), once(F.col("scored")).alias("scored"), (100.0 * F.avg(F.col("v.hit").cast("int"))).alias("hit_pct"),
        F.avg("v.call_excess").alias("mean_excess"), F.median("v.call_excess").alias("median_excess"), F.min("v.call_excess").alias("worst"), (once(F.col("scored")) >= enough).alias("enough"),
    )


def fold_repeats(calls: DataFrame, days: int) -> DataFrame:
    """The calls that count: without those that a later one corrects, of one day the latest id, and then without repeats
    of a verdict on a security less than so many days after the last one that counts."""
    if "corrects_id" in calls.columns:
        calls = calls.join(calls.where("corrects_id IS NOT NULL").select(F.col("corrects_id").alias("call_id")).distinct(), "call_id", "left_anti")
    single = calls.groupBy("security_id", "verdict", "date").agg(F.max("call_id").alias("call_id"))
    listed = single.groupBy("security_id", "verdict").agg(F.array_sort(F.collect_list(F.struct("date", "call_id"))).alias("c"))
    start = F.struct(F.lit(None).cast("date").alias("head"), F.array().cast("array<struct<date:date,call_id:bigint>>").alias("kept"))

    def put(a, x):
        new = a["head"].isNull() | (F.datediff(x["date"], a["head"]) >= days)
        return F.struct(F.when(new, x["date"]).otherwise(a["head"]).alias("head"), F.when(new, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"))

    return listed.select("security_id", "verdict", F.explode(F.aggregate("c", start, put, lambda a: a["kept"])).alias("k")).select("security_id", "verdict", "k.date", "k.call_id")


def survivors(calls: DataFrame, days: int) -> DataFrame:
    """call_id, final_id and why (kept, corrected, same_day, in_window): the call that each ledger row counts as.

    A corrected row goes where its correction goes, however long that chain is; if several rows correct one, the latest
    id does. Of one security, day and verdict the latest id stands; repeats within ``days`` of a call that counts fold
    into it. Corrections of unknown rows correct nothing; rows that correct each other in a circle have no final call.
    """
    rows = calls.select("call_id", "security_id", "verdict", "date", "corrects_id")
    by = rows.join(rows.select(F.col("call_id").alias("corrects_id")), "corrects_id").groupBy(F.col("corrects_id").alias("call_id")).agg(F.max("call_id").alias("corrected_by"))
    ends = chain_ends(rows.select("call_id").join(by, "call_id", "left"), "call_id", "corrected_by")
    live = rows.join(by, "call_id", "left_anti").drop("corrects_id")
    heads = fold_repeats(live, days).select(F.col("call_id").alias("latest"), F.col("call_id").alias("head"))
    single = live.groupBy("security_id", "verdict", "date").agg(F.max("call_id").alias("latest")).join(heads, "latest", "left")
    # a repeat folds into the last call that counts on or before its day
    single = single.withColumn("head", F.last("head", ignorenulls=True).over(Window.partitionBy("security_id", "verdict").orderBy("date")))
    stands = live.join(single, ["security_id", "verdict", "date"]).select(F.col("call_id").alias("last"), "head", "latest")
    found = ends.join(stands, "last", "left")
    why = F.when(F.col("last").isNull() | (F.col("call_id") != F.col("last")), "corrected").when(F.col("call_id") == F.col("head"), "kept").when(F.col("call_id") == F.col("latest"), "in_window").otherwise("same_day")
    return found.select("call_id", F.col("head").alias("final_id"), why.alias("why"))


def scored_calls(calls: DataFrame, final: DataFrame, scores: DataFrame, decisions: DataFrame, weeks: Sequence[int]) -> DataFrame:
    """One row for each call that counts and each horizon: call_id, weeks, verdict, status, call_excess, hit, acted.

    ``final`` comes from ``survivors``; ``scores``: call_id, weeks, status, call_excess, hit (the newest of each);
    ``decisions``: call_id, decision, effective rows. A horizon without a score is pending; a decision acted on, or in
    part, counts for the call that its row folded into.
    """
    kept = final.where("call_id = final_id").select("call_id")
    acted = decisions.where(F.col("decision").isin("acted", "partial")).select("call_id").join(final, "call_id").select(F.col("final_id").alias("call_id"), F.lit(True).alias("acted")).distinct()
    asked = calls.select("call_id", "verdict").join(kept, "call_id").withColumn("weeks", F.explode(F.array(*map(F.lit, weeks))))
    found = asked.join(scores.select("call_id", "weeks", "status", "call_excess", "hit"), ["call_id", "weeks"], "left").join(acted, "call_id", "left")
    return found.select("call_id", "weeks", "verdict", F.coalesce("status", F.lit("pending")).alias("status"), "call_excess", "hit", F.coalesce("acted", F.lit(False)).alias("acted"))


def latest_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The scored row of each key if there is one (the first), else the newest."""
    scored = F.col("status") == "scored"
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(scored, 0).otherwise(1), F.when(scored, F.col("id")).otherwise(-F.col("id"))))
    return scores.withColumn("turn", turn).where("turn = 1").drop("turn")
