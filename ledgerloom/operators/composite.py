"""Five factors from percentile inputs, and the composite that price can't lift above what the business supports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTORS = ["quality", "value", "growth", "momentum", "risk"]
SUPPORT = ["quality", "value", "growth"]


@dataclass(frozen=True)
class Input:
    """A column that holds a score of 0 to 100 or null."""

    name: str
    factor: str
    of_price: bool = False


@dataclass(frozen=True)
class Policy:
    """Weights by factor, least composites of the bands, and the limits on price-driven credit."""

    weights: dict[str, float]
    top: float = 75.0
    upper: float = 60.0
    hold: float = 40.0
    support_floor: float = 50.0
    penalty: float = 25.0
    penalty_over_pct: float = 90.0
    min_input_pct: float = 70.0


LONG_TERM = Policy({"quality": 30.0, "value": 25.0, "growth": 25.0, "momentum": 10.0, "risk": 10.0})
POSITIONAL = Policy({"quality": 15.0, "value": 10.0, "growth": 20.0, "momentum": 45.0, "risk": 10.0})


def known_mean(values: list[Column]) -> Column:
    """The mean of those that aren't null; null for none."""
    if not values:
        return F.lit(None).cast("double")
    known = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    total = reduce(lambda a, b: a + b, [F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])
    return F.when(known > 0, total / known)


def flag_health(hard: Column, soft: Column, evaluable: Column, per_hard: float = 50.0, per_soft: float = 20.0) -> Column:
    """100 less a penalty for each fired flag, 0 at least; null if no flag could be tested."""
    return F.when(evaluable > 0, F.greatest(F.lit(0.0), 100.0 - hard * per_hard - soft * per_soft))


def score(rows: DataFrame, inputs: list[Input], policy: Policy, valuation_percentile: Column, hard_flag: Column) -> DataFrame:
    """``rows`` with the five factors, support, composite, band and available (inputs).

    Momentum counts up to the support, less a penalty where the valuation is far up its own history; a price-driven
    part of risk too. Factors without inputs drop out and the others' weights are scaled up. The top band needs
    support, and a hard flag holds the band down. Too few inputs give no composite. What later steps use more than once
    is a column by then, so that expressions stay small.
    """
    def of(factor: str, price: bool | None = None) -> list[Column]:
        return [F.col(i.name) for i in inputs if i.factor == factor and price in (None, i.of_price)]

    col = F.col
    rows = rows.withColumns({f: known_mean(of(f)) for f in SUPPORT} | {"__momentum": known_mean(of("momentum")), "__hard": F.coalesce(hard_flag, F.lit(False)), "__far": F.coalesce(valuation_percentile > policy.penalty_over_pct, F.lit(False))})
    rows = rows.withColumn("support", known_mean([col(f) for f in SUPPORT])).withColumn("__held", F.coalesce("support", F.lit(0.0)))
    credit = F.least("__momentum", "__held")
    capped = {f"__{i.name}": F.when(col(i.name).isNotNull(), F.least(col(i.name), col("__held"))) for i in inputs if i.factor == "risk" and i.of_price}
    rows = rows.withColumns({"__credit": F.when(col("__momentum").isNotNull(), credit), **capped})
    credited = F.when(col("__far") & col("__credit").isNotNull(), F.greatest(F.lit(0.0), col("__credit") - policy.penalty)).otherwise(col("__credit"))
    rows = rows.withColumns({"momentum": credited, "risk": known_mean([*(col(c) for c in capped), *of("risk", False)])})
    weight = reduce(lambda a, b: a + b, [F.when(col(f).isNotNull(), F.lit(policy.weights[f])).otherwise(0.0) for f in FACTORS])
    total = reduce(lambda a, b: a + b, [F.coalesce(policy.weights[f] * col(f), F.lit(0.0)) for f in FACTORS])
    available = reduce(lambda a, b: a + b, [col(i.name).isNotNull().cast("int") for i in inputs])
    rows = rows.withColumns({"__weight": weight, "__total": total, "available": available})
    enough = (col("__weight") > 0) & (col("available") * 100 >= policy.min_input_pct * len(inputs))
    rows = rows.withColumns({"composite": F.when(enough, col("__total") / col("__weight")), "__supported": F.coalesce(col("support") >= policy.support_floor, F.lit(False))})
    composite = col("composite")
    free = F.when(composite.isNull(), "insufficient_data").when((composite >= policy.top) & col("__supported"), "top").when(composite >= policy.upper, "upper").when(composite >= policy.hold, "hold").otherwise("weak")
    rows = rows.withColumn("__band", free).withColumn("band", F.when(col("__hard") & col("__band").isin("top", "upper"), "hold").otherwise(col("__band")))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])
