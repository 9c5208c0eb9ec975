"""Reads as of a date: best source, newest filing, as-of values, month ends, corrected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_rank(column: str, priority: Sequence[str]) -> Column:
    """Place in the list of sources, unknown ones last."""
    found = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col(column))
    return F.when(found > 0, found).otherwise(len(priority) + 1)


def best_source(df: DataFrame, keys: Sequence[str], source: str, priority: Sequence[str]) -> DataFrame:
    """One row per key: that of the first source in the list; among unknown ones the first by name."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(source_rank(source, priority), source))
    return df.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def statement_source(df: DataFrame, keys: Sequence[str], source: str, priority: Sequence[str], as_of: Column, filed: str = "filed_at") -> DataFrame:
    """All filings up to ``as_of`` of each key's best source; sources are ranked after the cut, so a later one can't win."""
    turn = F.dense_rank().over(Window.partitionBy(*keys).orderBy(source_rank(source, priority), source))
    return df.where(F.col(filed) <= as_of).withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def latest_as_of(df: DataFrame, keys: Sequence[str], as_of: Column, filed: str = "filed_at", ties: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key that was filed by ``as_of``."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(filed), *ties))
    return df.where(F.col(filed) <= as_of).withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_date: str, right_date: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the last right row on or before its date; no range join.

    The different dates of each key, not the left rows, are ordered with the right rows in one running window; left rows
    then meet the answers by key and date. Null keys and dates have no match.
    """
    shown = right.where(F.col(right_date).isNotNull()).select(*keys, F.col(right_date).alias("__at"), F.struct(F.col(right_date), *values).alias("__value"), F.lit(0).alias("__side"))
    dates = left.select(*keys, F.col(left_date).alias("__at")).dropna().distinct()
    asked = dates.withColumns({"__value": F.lit(None).cast(shown.schema["__value"].dataType), "__side": F.lit(1)})
    last = F.last("__value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0))
    told = shown.unionByName(asked).withColumn("__last", last).where("__side = 1").select(*keys, F.col("__at"), F.col("__last"))
    joined = left.withColumn("__at", F.col(left_date)).join(told, [*keys, "__at"], "left")
    return joined.select(*left.columns, F.col(f"__last.{right_date}").alias(f"asof_{right_date}"), *[F.col(f"__last.{v}").alias(f"asof_{v}") for v in values])


def month_ends(bars: DataFrame, key: str = "security_id", date: str = "date", value: str = "close") -> DataFrame:
    """The last value of each calendar month."""
    return bars.groupBy(key, F.trunc(date, "month").alias("month")).agg(F.max(date).alias(date), F.max_by(value, date).alias(value))


def effective_rows(df: DataFrame, row_id: str = "id", corrects: str = "corrects_id") -> DataFrame:
    """Rows that no later row corrects."""
    gone = df.where(F.col(corrects).isNotNull()).select(F.col(corrects).alias(row_id)).distinct()
    return df.join(gone, row_id, "left_anti")
