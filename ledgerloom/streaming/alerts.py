"""Streaming forms of what is otherwise counted over stored rows: repeats folded, calls counted by window, newest bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_alerts(alerts: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The first alert of each key and day; state for a day is dropped once it is later than ``late``."""
    daily = alerts.withColumn("day", F.date_trunc("day", time))
    return daily.withWatermark("day", late).dropDuplicates([*keys, "day"])


def calls_by_window(calls: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """Number of metered calls by window and keys."""
    counted = calls.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("calls"))
    return counted.select(F.col("window.start").alias("start"), *keys, "calls")


def newest_by_key(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """For ``foreachBatch``: a batch's newest row of each key, ready to replace what is stored."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return batch.withColumn("__turn", turn).where("__turn = 1").drop("__turn")
