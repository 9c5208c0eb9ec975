"""Rules over metrics, cohort scores, capped shortlists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import mid_rank

OPERATORS = ("<", "<=", ">", ">=", "==", "!=", "between")


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    operator: str
    value: float | str | tuple[float, float]
    required: bool = False

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator}")
        if (self.operator == "between") != isinstance(self.value, tuple):
            raise ValueError("between takes two values, other operators one")
        if isinstance(self.value, str) and self.operator not in ("==", "!="):
            raise ValueError("text is only compared for equality")

    def passes(self) -> Column:
        """Null where the metric is unavailable."""
        metric = F.col(self.metric)
        if self.operator == "between":
            return metric.between(*self.value)
        return {"<": metric < self.value, "<=": metric <= self.value, ">": metric > self.value, ">=": metric >= self.value, "==": metric == self.value, "!=": metric != self.value}[self.operator]


def check_rules(rules: Sequence[Rule], most: int = 50) -> None:
    if not rules or len(rules) > most:
        raise ValueError(f"1 to {most} rules")
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("names must differ")


def screen(metrics: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each security with ``matched``, ``partial`` (a rule was skipped), the first rule that failed, and what was skipped.

    Rules are evaluated in order until one fails. An unavailable metric skips its rule, or fails a required one; a
    security whose rules are all skipped doesn't match.
    """
    check_rules(rules)
    failed = [F.when(F.coalesce(~r.passes(), F.lit(r.required)), r.name) for r in rules]
    skipped = F.filter(F.array(*[F.when(r.passes().isNull() & F.lit(not r.required), r.name) for r in rules]), lambda x: x.isNotNull())
    seen = metrics.withColumns({"failed": F.coalesce(*failed), "skipped": skipped})
    matched = F.col("failed").isNull() & (F.size("skipped") < len(rules))
    return seen.withColumns({"matched": matched, "partial": matched & (F.size("skipped") > 0)})


def cohort_scores(values: DataFrame, metric: str, lower_is_better: bool, least_peers: int) -> DataFrame:
    """Percentile within the sector if it has enough members with a value, else within all."""
    peers = F.count(metric).over(Window.partitionBy("sector"))
    score = F.when(peers >= least_peers, mid_rank(F.col(metric), "sector")).otherwise(mid_rank(F.col(metric)))
    return values.withColumns({f"{metric}_score": 100 - score if lower_is_better else score, f"{metric}_cohort": F.when(peers >= least_peers, "sector").otherwise("market")})


def shortlist(scored: DataFrame, size: int, sector_cap: int) -> DataFrame:
    """The best by composite, at most so many of a sector; the unclassified are not capped."""
    order = [F.col("composite").desc_nulls_last(), F.col("security_id")]
    turn = F.row_number().over(Window.partitionBy("sector").orderBy(*order))
    return scored.withColumn("turn", turn).where((F.col("turn") <= sector_cap) | F.col("sector").isNull()).drop("turn").orderBy(*order).limit(size)


def competition_rank(column: str, lower_is_better: bool, *keys: str) -> Column:
    """Rank with gaps; missing values rank after all others."""
    order = F.col(column).asc_nulls_last() if lower_is_better else F.col(column).desc_nulls_last()
    return F.rank().over(Window.partitionBy(*keys).orderBy(order))
