"""Tests of rows and series before they are stored or read: fields, order, sources against each other, sessions, sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decimal_fault(text: Column) -> Column:
    """Why a text is no finite number once its grouping commas are gone; null for a sound one."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    return F.when(text.isNull() | (plain == ""), "missing").when(plain.try_cast("decimal(38,10)").isNull(), "not a number")


def value_fault(day: Column, today: Column, **values: Column) -> Column:
    """The first fault of a row: a negative value (by name), then a day after ``today``; null for a sound one."""
    return F.coalesce(*[F.when(v < 0, f"{n} negative") for n, v in values.items()], F.when(day > today, "date in the future"))


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Columns that a file lacks, in order."""
    return [c for c in wanted if c not in df.columns]


def audit(rows: DataFrame, fault: Column, *by: str) -> DataFrame:
    """Faulty rows counted by reason and ``by``."""
    return rows.withColumn("reason", fault).where("reason is not null").groupBy("reason", *by).agg(F.count("*").alias("rows"))


def series_faults(points: DataFrame, key: str, value: str) -> DataFrame:
    """Points that break a series: a value that is not positive, or a day that the series already has; (key, date, reason)."""
    again = F.lag("date").over(Window.partitionBy(key).orderBy("date", value)) == F.col("date")
    why = F.when(F.col(value).isNull() | (F.col(value) <= 0), "not positive").when(again, "repeated date")
    return points.withColumn("reason", why).where("reason is not null").select(key, "date", "reason")


def disagreements(points: DataFrame, key: str, first: str, second: str, tolerance: float) -> DataFrame:
    """Days on which two sources of a key differ by more than a share of the first's value: key, date, value, other."""
    sides = {n: points.where(F.col("source") == s).select(key, "date", F.col("value").alias(n)) for n, s in (("value", first), ("other", second))}
    both = sides["value"].join(sides["other"], [key, "date"])
    return both.where((F.col("value") != 0) & (F.abs(F.col("value") - F.col("other")) / F.col("value") > tolerance))


def missing_sessions(points: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Sessions between a key's first and last day on which it has no point: key, date.

    ``sessions`` is (date), a calendar: some hundred rows a year, which is what a key's span is met with.
    """
    spans = points.groupBy(key).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = spans.select(key, F.explode(F.sequence("a", "b")).alias("date")).join(sessions.select("date").distinct(), "date", "left_semi")
    return days.join(points.select(key, "date").distinct(), [key, "date"], "left_anti")


def trailing_gap(points: DataFrame, key: str, until: Column, limit: int) -> DataFrame:
    """Keys with more than ``limit`` weekdays after their last point up to a day: gap_from, gap_to, days."""
    last = points.groupBy(key).agg(F.max("date").alias("last")).where(F.col("last") < until)
    days = F.filter(F.sequence(F.date_add("last", 1), until), lambda d: F.dayofweek(d).between(2, 6))
    return last.withColumn("days", days).where(F.size("days") > limit).select(key, F.array_min("days").alias("gap_from"), F.array_max("days").alias("gap_to"), F.size("days").alias("days"))


def chunk(text: Column, cursor: int, size: int, most: int = 20_000) -> tuple[Column, Column]:
    """A part of a text from a cursor on, at most ``most`` characters, and the next cursor (null at the end)."""
    size = max(1, min(size, most))
    after = F.lit(cursor + size)
    return F.substring(text, cursor + 1, size), F.when(after < F.length(text), after)


def cache_state(entries: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """adapter, entries, newest, stale: whether the newest entry is older than the time to live."""
    found = entries.groupBy("adapter").agg(F.count("*").alias("entries"), F.max("fetched_at").alias("newest"))
    return found.withColumn("stale", now.cast("timestamp") - F.col("newest") > F.expr(f"INTERVAL {ttl_days} DAYS"))


def fund_changes(versions: DataFrame, key: str, ter_points: float) -> DataFrame:
    """key, as_of, change: what moved since the version before: manager, category, expense ratio beyond ``ter_points``, merger.

    A new value counts if it is known. A merger is guessed from another code, or a name or source that speaks of one.
    """
    own = Window.partitionBy(key).orderBy("as_of")
    held = ("manager", "category", "ter", "code")
    seen = versions.withColumns({f"__{c}": F.lag(c).over(own) for c in held} | {"__n": F.row_number().over(own)}).where("__n > 1")
    moved = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    merged = ~F.col("code").eqNullSafe(F.col("__code")) | F.coalesce(F.lower(F.concat_ws(" ", "name", "source")).rlike("\\bmerg"), F.lit(False))
    tests = {"manager": moved("manager"), "category": moved("category"), "ter": F.coalesce(F.abs(F.col("ter") - F.col("__ter")) > ter_points, F.lit(False)), "merger": merged}
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return seen.select(key, "as_of", F.explode(found).alias("change"))
