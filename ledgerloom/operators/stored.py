"""Reads and writes of stored rows: versions, snapshots, pages, amended forms, month-end prices, superseded figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.pit import asof_join, source_rank


def best_version(df: DataFrame, keys: Sequence[str], source: str, priority: Sequence[str], filed: str = "filed_at") -> DataFrame:
    """One whole row of each key: of the most trusted source, its newest filing; ties by source."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(source_rank(source, priority), F.desc(filed), source))
    return df.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def page(df: DataFrame, order: Sequence[Column], rows: int, skip: int = 0) -> DataFrame:
    """A page of so many rows in an order, after those skipped."""
    return df.orderBy(*order).offset(skip).limit(rows)


def base_form(form: Column) -> Column:
    """A filing's form without the mark of an amendment."""
    return F.regexp_replace(F.trim(form), "/A$", "")


def newest_and_before(df: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], as_of: str) -> DataFrame:
    """The newest row of each key on or before a day, with what it was at the day before that (null for a first one)."""
    own = Window.partitionBy(*keys).orderBy(day)
    seen = df.where(F.col(day) <= F.lit(as_of).cast("date")).withColumns({f"before_{c}": F.lag(c).over(own) for c in (day, *values)})
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(day)))
    return seen.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def price_on_month_end(bars: DataFrame, days: DataFrame, oldest: int = 10) -> DataFrame:
    """security_id, month_end and the last close on or before it, unless that is more than ``oldest`` days old."""
    found = asof_join(days, bars, ["security_id"], "month_end", "date", ["close"])
    return found.where(F.datediff("month_end", "asof_date") <= oldest).select("security_id", "month_end", F.col("asof_date").alias("date"), F.col("asof_close").alias("close"))


def supersede(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], sources: Sequence[str], source: str = "source") -> DataFrame:
    """Stored rows and fresh ones; a fresh figure of one of ``sources`` takes the place of all that this source said of it."""
    gone = fresh.where(F.col(source).isin(*sources)).select(*keys, source).distinct()
    return stored.join(gone, [*keys, source], "left_anti").unionByName(fresh)


def replace_partition(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fresh rows in place of everything stored under their keys, as for the holdings of a month or an index's members."""
    return stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def cover(covered: Column, held: Column) -> Column:
    """How dated lots compare with the quantity held: none, partial, exact or over."""
    lots = F.coalesce(covered, F.lit(0))
    return F.when(lots == 0, "none").when(lots < held, "partial").when(lots == held, "exact").otherwise("over")


def lateness(at: Column, instant: Column, grace_minutes: int, catchup_hours: float) -> Column:
    """on_time, late beyond the grace, missed beyond the catch-up window."""
    age = F.unix_micros(at.cast("timestamp")) - F.unix_micros(instant.cast("timestamp"))
    return F.when(age > int(catchup_hours * 3600e6), "missed").when(age > int(grace_minutes * 60e6), "late").otherwise("on_time")


def stale(latest: Column, expected: Column) -> Column:
    """Whether the newest stored date is before the session that it should cover."""
    return latest.isNull() | (latest < expected)


def refuse_look_ahead(start: date, model: str, cutoffs: Mapping[str, date]) -> None:
    """Raise unless an evaluation from ``start`` begins after the recorded training cutoff of the model."""
    if model not in cutoffs:
        raise ValueError(f"no training cutoff is recorded for {model}, so the evaluation may overlap it")
    if start <= cutoffs[model]:
        raise ValueError(f"an evaluation from {start} is not after the training cutoff {cutoffs[model]} of {model}")
