"""Statistics as columns: ranks within a cohort, moments, returns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def mid_rank(value: Column, *cohort: str) -> Column:
    """100 * (lower + equal / 2) / n within the cohort; null values have none and don't count; a cohort of one is 50."""
    at_most = Window.partitionBy(*cohort).orderBy(value.asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.count(value).over(at_most).cast("double")
    equal = F.count(value).over(Window.partitionBy(*cohort, value)).cast("double")
    return F.when(value.isNotNull(), 100.0 * (below - 0.5 * equal) / F.count(value).over(Window.partitionBy(*cohort)))


def annual_growth(first: Column, last: Column, days: Column) -> Column:
    """Compound growth by act/365; null unless both ends are positive and time has passed."""
    return F.when((first > 0) & (last > 0) & (days > 0), F.exp(F.ln(last / first) * 365.0 / days) - 1)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.when(b != 0, a / b)


def r6(value: Column) -> Column:
    """Half-even at six decimals, the precision that results are compared at."""
    return F.bround(value, 6)
