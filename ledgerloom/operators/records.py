"""Registers and logs: fund schemes, aliases, venues, actions, theses, watched zones, quotas, jobs, levels, holdings of a month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.pit import source_rank

# How venues may be written; words of plans that don't grow.
VENUES = {"NYSE": "NYSE", "NASDAQ": "NASDAQ", "ARCA": "ARCA", "NYSE ARCA": "ARCA", "NYSEARCA": "ARCA", "AMEX": "NYSE", "NYSE AMERICAN": "NYSE"}
PAYING = r"\b(?:idcw|payout|dividend|reinvest\w*)\b"
WARN_PCT = 80


def venue(label: Column) -> Column:
    """The venue of a label in any case and spacing, null for an unknown one."""
    plain = F.upper(F.trim(F.regexp_replace(label, r"\s+", " ")))
    out = F.lit(None).cast("string")
    for spelled, name in VENUES.items():
        out = F.when(plain == spelled, name).otherwise(out)
    return out


def scheme_rows(securities: DataFrame) -> DataFrame:
    """One row (security_id, name, code) of each scheme code: that of a name which grows, else the lowest id."""
    pays = F.coalesce(F.lower("name").rlike(PAYING), F.lit(False))
    turn = F.row_number().over(Window.partitionBy("code").orderBy(pays, "security_id"))
    return securities.where("code is not null").withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def resolve_isins(asked: DataFrame, securities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``asked`` (isin) with security_id: of the lowest id that has it, else of the lowest one that an alias leads to.

    Securities that are placeholders (``unresolved``) are not found.
    """
    real = securities.where("not unresolved").select("security_id", F.upper(F.trim("isin")).alias("__isin"))
    direct = real.where("__isin is not null").select("__isin", "security_id", F.lit(0).alias("__way"))
    old = aliases.join(real.select("security_id"), "security_id").select(F.upper(F.trim("isin")).alias("__isin"), "security_id", F.lit(1).alias("__way"))
    found = direct.unionByName(old).groupBy("__isin").agg(F.min(F.struct("__way", "security_id")).alias("__best")).select("__isin", F.col("__best.security_id").alias("security_id"))
    return asked.withColumn("__isin", F.upper(F.trim("isin"))).join(found, "__isin", "left").drop("__isin")


def numbered_actions(actions: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Actions with ``turn``, their order within a security: by ex-date, trust in the source, its name, kind."""
    return actions.withColumn("turn", F.row_number().over(Window.partitionBy("security_id").orderBy("ex_date", source_rank("source", priority), "source", "kind")))


def refused_theses(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh active theses that can't be saved: their security has an active one, or an earlier fresh one (by id) takes its place."""
    held = stored.where("status = 'active'").select("security_id", F.lit(True).alias("__held")).distinct()
    turn = F.row_number().over(Window.partitionBy("security_id").orderBy("thesis_id"))
    wanted = fresh.where("status = 'active'").withColumn("__turn", turn).join(held, "security_id", "left")
    return wanted.where("__held or __turn > 1").drop("__turn", "__held")


def zone_fault(low: Column, high: Column) -> Column:
    """Why an entry zone can't be watched: it needs both ends or none, in order and above zero."""
    return F.when(low.isNull() != high.isNull(), "one end missing").when(low <= 0, "not positive").when(low > high, "ends reversed")


def month_window(today: Column, start_day: int) -> tuple[Column, Column]:
    """First day of the month window that a day is in, and of the next one, when windows begin on ``start_day`` (28 at most)."""
    first = F.date_add(F.trunc(F.date_sub(today, start_day - 1), "month"), start_day - 1)
    return first, F.date_add(F.add_months(F.trunc(first, "month"), 1), start_day - 1)


def quota_state(calls: DataFrame, limits: DataFrame, today: Column, start_day: int) -> DataFrame:
    """vendor, used_today, used_month, manual_month, daily, monthly, warned: use against the newest limits that are set.

    ``calls`` is (vendor, day, calls, kind), ``limits`` (vendor, id, daily, monthly); a limit that was never set is null.
    """
    first, after = month_window(today, start_day)
    inside = (F.col("day") >= first) & (F.col("day") < after)
    whole = lambda on: F.coalesce(F.sum(F.when(on, F.col("calls"))), F.lit(0))
    used = calls.groupBy("vendor").agg(whole(F.col("day") == today).alias("used_today"), whole(inside).alias("used_month"), whole(inside & (F.col("kind") == "manual")).alias("manual_month"))
    set_last = limits.groupBy("vendor").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in ("daily", "monthly")])
    near = lambda use, cap: F.coalesce(F.col(use) * 100 >= F.col(cap) * WARN_PCT, F.lit(False))
    return used.join(set_last, "vendor", "left").withColumn("warned", near("used_today", "daily") | near("used_month", "monthly"))


def last_runs(runs: DataFrame) -> DataFrame:
    """Whole rows of the newest trading day of each job (job, trading_date, ...)."""
    turn = F.rank().over(Window.partitionBy("job").orderBy(F.desc("trading_date")))
    return runs.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def latest_levels(levels: DataFrame) -> DataFrame:
    """security_id, level: of the row that was written last."""
    return levels.groupBy("security_id").agg(F.max_by("level", "id").alias("level"))


def scored_keys(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that have a scored row, once each."""
    return scores.where("status = 'scored'").select(*keys).distinct()


def month_holdings(holdings: DataFrame, month: Column) -> DataFrame:
    """A month's holdings with ``turn`` within each fund: by weight, the largest first, then by isin."""
    own = holdings.where(F.col("month") == month)
    return own.withColumn("turn", F.row_number().over(Window.partitionBy("fund").orderBy(F.desc("weight"), "isin")))
