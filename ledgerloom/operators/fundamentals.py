"""Statements and valuation as columns and frames: period kinds, flags, discounted values, peers, cross-checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.pit import source_rank

#: Growth that the solver looks between, and its halvings.
GROWTH_LOW, GROWTH_HIGH, STEPS = -0.5, 1.0, 80


def period_kind(start: Column, end: Column) -> Column:
    """A for a year, Q for a quarter, YTD for two or three quarters, instant without a start, else other."""
    days = F.datediff(end, start)
    ytd = days.between(170, 190) | days.between(260, 285)
    return F.when(start.isNull(), "instant").when(days.between(350, 380), "A").when(days.between(80, 100), "Q").when(ytd, "YTD").otherwise("other")


def rise_flag(before: Column, now: Column, limit_pct: float) -> Column:
    """fired if ``now`` is more than ``limit_pct`` percent above ``before``; not_evaluable unless ``before`` is positive."""
    return F.when(before.isNull() | now.isNull() | (before <= 0), "not_evaluable").when((now / before - 1) * 100 > limit_pct, "fired").otherwise("clear")


def discounted_value(cash_flow: Column, growth: Column, discount: float, terminal: float, years: int) -> Column:
    """Present value of flows that grow for ``years`` years, the first a year out, and of what follows at ``terminal``."""
    step = (1 + growth) / (1 + discount)
    held = F.aggregate(
        F.sequence(F.lit(1), F.lit(years)),
        F.struct(F.lit(1.0).alias("power"), F.lit(0.0).alias("sum")),
        lambda s, _: F.struct((s["power"] * step).alias("power"), (s["sum"] + s["power"] * step).alias("sum")),
        lambda s: s["sum"] + s["power"] * ((1 + terminal) / (discount - terminal)),
    )
    return cash_flow * held


def _halved(discount: float, terminal: float, years: int):
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for caps, flows in batches:
            cap, flow = (x.to_numpy(dtype=float, na_value=np.nan) for x in (caps, flows))

            def at(growth: np.ndarray | float) -> np.ndarray:
                # the additions of discounted_value, in its order
                step, power, held = (1 + growth) / (1 + discount), 1.0, 0.0
                for _ in range(years):
                    power = power * step
                    held = held + power
                return flow * (held + power * ((1 + terminal) / (discount - terminal)))

            with np.errstate(all="ignore"):
                low, high = np.full(len(cap), GROWTH_LOW), np.full(len(cap), GROWTH_HIGH)
                inside = (cap >= at(GROWTH_LOW)) & (cap <= at(GROWTH_HIGH))
                for _ in range(STEPS):
                    middle = (low + high) / 2
                    under = at(middle) < cap
                    low, high = np.where(under, middle, low), np.where(under, high, middle)
            found = pd.Series((low + high) / 2)
            yield found.where(inside, None)

    return measure


def implied_growth(cap: Column, cash_flow: Column, discount: float, terminal: float, years: int) -> Column:
    """The growth at which the discounted value is ``cap``, by halving; null outside the range that is searched.

    A batch of rows is halved at once: as expressions of Spark, 80 times ten steps a row are slow.
    """
    return F.pandas_udf(_halved(discount, terminal, years), "double")(cap.cast("double"), cash_flow.cast("double"))


def peer_median(values: DataFrame, cohort: str, value: str, least: int) -> DataFrame:
    """Each row with ``peer_median``: the median of the others of its cohort, null with fewer than ``least`` of them.

    Others' medians are read off the cohort's three middle values, so no pairs are formed. Null values have no peers
    and are none.
    """
    known = values.where(F.col(value).isNotNull())
    place = known.withColumn("__r", F.row_number().over(Window.partitionBy(cohort).orderBy(value))).withColumn("__n", F.count("*").over(Window.partitionBy(cohort)))
    low = F.floor(F.col("__n") / 2)
    middle = place.withColumn("__low", low).groupBy(cohort).agg(*[F.max(F.when(F.col("__r") == F.col("__low") + k, F.col(value))).alias(f"__v{k}") for k in range(3)])
    joined = place.join(middle, cohort).withColumn("__low", low)

    def without_own(k: int) -> Column:
        return F.when(F.col("__low") + k < F.col("__r"), F.col(f"__v{k}")).otherwise(F.col(f"__v{k + 1}"))

    # n - 1 others: an odd n has two middle ones, from place (n - 1) / 2 on; an even n has one, at place n / 2
    median = F.when(F.col("__n") % 2 == 0, without_own(0)).otherwise((without_own(0) + without_own(1)) / 2)
    out = joined.withColumn("peer_median", F.when(F.col("__n") > least, median)).drop("__r", "__n", "__low", "__v0", "__v1", "__v2")
    return out.unionByName(values.where(F.col(value).isNull()).withColumn("peer_median", F.lit(None).cast("double")))


def cross_check(figures: DataFrame, keys: Sequence[str], source: str, value: str, priority: Sequence[str], tolerance_pct: float) -> DataFrame:
    """Each figure against that of the most trusted source that has it: base, match, differs, or only for a lone one.

    A value other than zero differs from a base of zero."""
    own = Window.partitionBy(*keys)
    base = F.min(F.struct(source_rank(source, priority).alias("rank"), F.col(source).alias("name"), F.col(value).alias("value"))).over(own)
    ranked = figures.withColumn("__base", base).withColumn("__n", F.count("*").over(own))
    near = F.abs(F.col(value) - F.col("__base.value")) * 100 <= tolerance_pct * F.abs(F.col("__base.value"))
    status = F.when(F.col("__n") == 1, "only").when(F.col(source) == F.col("__base.name"), "base").when(near, "match").otherwise("differs")
    return ranked.select(*keys, source, F.col("__base.name").alias("base"), status.alias("status"))


def macro_year_change(series: DataFrame, key: str, date: str, value: str, within: int = 20) -> DataFrame:
    """Percent change of each series' last value over the one nearest to a year before, at most ``within`` days off it.

    The earlier date wins a tie; only points near the target are compared.
    """
    present = series.where(F.col(value).isNotNull())
    last = present.groupBy(key).agg(F.max(date).alias("last_date"), F.max_by(value, date).alias("last_value"))
    off = F.abs(F.datediff(F.col(date), F.add_months("last_date", -12)))
    near = present.join(last, key).where((off <= within) & (F.col(date) < F.col("last_date"))).groupBy(key).agg(F.min_by(value, F.struct(off, F.col(date))).alias("near"))
    change = F.when(F.col("near") != 0, (F.col("last_value") / F.col("near") - 1) * 100)
    return last.join(near, key, "left").select(key, "last_date", "last_value", change.alias("yoy_pct"))


#: Items that are kept as positive outflows whatever their sign in the filing.
OUTFLOWS = ["capex"]


def quarterise(facts: DataFrame) -> DataFrame:
    """security_id, item, period_type (A or Q), period_end, value, filed_at, from reported facts.

    ``facts`` is (security_id, item, rank, start, end, value, filed, annual_form). Of facts for one item and span those
    of the lowest rank count. A quarter that isn't reported is the difference of two spans with one start. A later
    filing of the same value is not a restatement.
    """
    span = Window.partitionBy("security_id", "item", "start", "end")
    chosen = facts.withColumn("__best", F.min("rank").over(span)).where(F.col("rank") == F.col("__best")).withColumn("kind", period_kind(F.col("start"), F.col("end"))).where("kind <> 'other'")
    types = F.when(F.col("kind") == "instant", F.when(F.col("annual_form"), F.array(F.lit("Q"), F.lit("A"))).otherwise(F.array(F.lit("Q")))).when(F.col("kind") == "YTD", F.array().cast("array<string>")).otherwise(F.array("kind"))
    direct = chosen.select("security_id", "item", F.explode(types).alias("period_type"), F.col("end").alias("period_end"), "value", F.col("filed").alias("filed_at"))
    spans = chosen.where("kind <> 'instant'").groupBy("security_id", "item", "start", "end").agg(F.max_by("value", F.struct("filed", "value")).alias("value"), F.max("filed").alias("filed"), F.max((F.col("kind") == "Q").cast("int")).alias("q"))
    before = Window.partitionBy("security_id", "item", "start").orderBy("end")
    told = F.max("q").over(Window.partitionBy("security_id", "item", "end"))
    stepped = spans.withColumns({"v0": F.lag("value").over(before), "f0": F.lag("filed").over(before), "told": told}).where("v0 is not null and told = 0")
    steps = stepped.select("security_id", "item", F.lit("Q").alias("period_type"), F.col("end").alias("period_end"), (F.col("value") - F.col("v0")).alias("value"), F.greatest("filed", "f0").alias("filed_at"))
    rows = direct.unionByName(steps).withColumn("value", F.when(F.col("item").isin(*OUTFLOWS), F.abs("value")).otherwise(F.col("value")))
    filings = Window.partitionBy("security_id", "item", "period_type", "period_end").orderBy("filed_at", "value")
    return rows.withColumn("__last", F.lag("value").over(filings)).where("__last is null or __last <> value").drop("__last")


def revision(snapshots: DataFrame, as_of: Column, days: int) -> DataFrame:
    """From (security_id, date, value): up, down or flat between the last snapshot ``days`` before and the last one; null if history is shorter.

    Of snapshots of one day the larger counts.
    """
    known = snapshots.where((F.col("date") <= as_of) & F.col("value").isNotNull())
    point = F.struct("date", "value")
    seen = known.groupBy("security_id").agg(F.max(point).alias("now"), F.max(F.when(F.col("date") <= F.date_sub(as_of, days), point)).alias("then"))
    now, then = F.col("now.value"), F.col("then.value")
    told = F.when(now > then, "up").when(now < then, "down").otherwise("flat")
    return seen.select("security_id", F.when(F.col("then").isNotNull(), told).alias("direction"))


def multiples(price: Column, eps: Column, shares: Column, equity: Column, ebitda: Column, debt: Column, cash: Column, fcf: Column, dividend: Column) -> dict[str, tuple[Column, Column]]:
    """Each multiple with the reason why it is null: pe, pb, ev_ebitda, fcf_yield_pct, dividend_yield_pct."""
    cap = price * shares
    uncapped = F.when(cap.isNull(), "no share count")

    def by(part: Column, whole: Column, name: str) -> tuple[Column, Column]:
        known = part.isNotNull() & (whole > 0)
        why = F.when(known, None).when(whole.isNull(), f"no {name}").when(whole <= 0, f"{name} is not positive")
        return F.when(known, part / whole), why

    pe, pb, ev = by(price, eps, "eps"), by(cap, equity, "equity"), by(cap + debt - cash, ebitda, "ebitda")
    return {
        "pe": pe,
        "pb": (pb[0], F.coalesce(uncapped, pb[1])),
        "ev_ebitda": (ev[0], F.coalesce(uncapped, F.when(debt.isNull(), "no debt").when(cash.isNull(), "no cash"), ev[1])),
        "fcf_yield_pct": (F.when(cap > 0, 100 * fcf / cap), F.coalesce(uncapped, F.when(fcf.isNull(), "no cash flow"))),
        "dividend_yield_pct": (F.when(price > 0, 100 * dividend / price), F.when(dividend.isNull(), "no dividend")),
    }


def pledge_flag(last: Column, rising: Column, limit_pct: float = 20.0) -> Column:
    """fired above the limit or on a rise in each of the last quarters; ``rising`` is null where there are too few of them."""
    return F.when(last.isNull(), "not_evaluable").when((last > limit_pct) | F.coalesce(rising, F.lit(False)), "fired").when(rising.isNull(), "not_evaluable").otherwise("clear")


def cash_flag(cash_flow: Column, profit: Column, least: float = 0.5) -> Column:
    """fired where the years' cash flow is below its share of their profit."""
    return F.when(cash_flow.isNull() | profit.isNull() | (profit <= 0), "not_evaluable").when(cash_flow / profit < least, "fired").otherwise("clear")


def contingent_flag(liabilities: Column, worth: Column, limit_pct: float = 20.0) -> Column:
    return F.when(liabilities.isNull() | worth.isNull() | (worth <= 0), "not_evaluable").when(100 * liabilities / worth > limit_pct, "fired").otherwise("clear")


def auditor_flag(filings: Column, changes: Column) -> Column:
    """``filings`` seen in the look-back and how many of them report a change; none seen rules nothing out."""
    return F.when(F.coalesce(filings, F.lit(0)) == 0, "not_evaluable").when(changes > 0, "fired").otherwise("clear")


def last_change(series: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """key, last_value, changed_on: when the current value first stood; null if it never changed."""
    moved = series.where(F.col(value).isNotNull()).withColumn("__before", F.lag(value).over(Window.partitionBy(key).orderBy(date)))
    return moved.groupBy(key).agg(F.max_by(value, date).alias("last_value"), F.max(F.when(F.col("__before") != F.col(value), F.col(date))).alias("changed_on"))


def attributable_profit(income: Column, minority: Column, eps: Column, shares: Column, tolerance_pct: float = 3.0) -> tuple[Column, Column]:
    """The parent's profit and its basis: reported_minority, no_minority, eps_x_shares, or unknown.

    Without a reported minority, earnings per share times shares tell whether there is one: within the tolerance there
    is none, a larger consolidated income gives the product, and a smaller one can't be explained and stays.
    """
    parent = eps * shares
    gap = F.bround((income - parent) / parent * 100, 2)
    basis = F.when(income.isNull(), "unknown").when(minority.isNotNull(), "reported_minority").when(parent.isNull() | (parent <= 0), "unknown").when(F.abs(gap) <= tolerance_pct, "no_minority").when(gap > 0, "eps_x_shares").otherwise("unknown")
    return F.when(basis == "reported_minority", income - minority).when(basis == "eps_x_shares", parent).otherwise(income), basis
