"""From filings to values: trailing earnings, free cash flow, scenario ranges, estimate revisions, owners' shares, fund analysis and lots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import ratio
from ledgerloom.operators.fundamentals import discounted_value, implied_growth
from ledgerloom.operators.funds import daily_risk, rolling_returns
from ledgerloom.operators.pit import latest_as_of

# Days that four quarter ends span; verdicts that make an idea, and the order of convictions; units lots may be off.
TTM_SPAN = (240, 300)
UPWARD, CONVICTIONS = ("BUY", "ACCUMULATE"), ("high", "medium", "low")
UNIT_TOLERANCE = 0.001


def known_figures(rows: DataFrame, as_of: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest filing of each (security_id, item, period_type, period_end) by ``as_of``; later periods don't count."""
    return latest_as_of(rows.where(F.col("period_end") <= as_of), ["security_id", "item", "period_type", "period_end"], as_of, "filed_at", ties)


def facts(known: DataFrame, newest: tuple[str, ...], annual: tuple[str, ...]) -> DataFrame:
    """security_id, eps, eps_basis, and items from known figures: the newest of any period, or of a year.

    eps is the sum of the last four quarters if their ends span three quarters, else the last year's.
    """
    turn = F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("period_end"), "period_type"))
    quarters = known.where("item = 'eps' and period_type <> 'A'").withColumn("__k", turn).where("__k <= 4")
    summed = quarters.groupBy("security_id").agg(F.count("*").alias("__n"), F.sum("value").alias("__ttm"), F.datediff(F.max("period_end"), F.min("period_end")).alias("__span"))
    ttm = summed.where((F.col("__n") == 4) & F.col("__span").between(*TTM_SPAN)).select("security_id", "__ttm")
    place = F.struct("period_end", F.when(F.col("period_type") == "A", 1).otherwise(0))
    last = lambda item, only: F.max_by("value", F.when((F.col("item") == item) & only, place))
    yearly = F.col("period_type") == "A"
    items = known.groupBy("security_id").agg(last("eps", yearly).alias("__eps"), *[last(i, F.lit(True)).alias(i) for i in newest], *[last(i, yearly).alias(i) for i in annual])
    both = items.join(ttm, "security_id", "left")
    basis = F.when(F.col("__ttm").isNotNull(), "ttm").when(F.col("__eps").isNotNull(), "last_annual")
    return both.select("security_id", F.coalesce("__ttm", "__eps").alias("eps"), basis.alias("eps_basis"), *newest, *annual)


def free_cash_flow(known: DataFrame) -> DataFrame:
    """security_id, period_end, cash_flow: of the newest year that has both operating cash flow and capital expenditure."""
    one = lambda item: F.max(F.when(F.col("item") == item, F.col("value")))
    years = known.where("period_type = 'A'").groupBy("security_id", "period_end").agg(one("cfo").alias("cfo"), one("capex").alias("capex"))
    whole = years.where("cfo is not null and capex is not null").withColumn("cash_flow", F.col("cfo") - F.abs("capex"))
    return whole.groupBy("security_id").agg(F.max("period_end").alias("period_end"), F.max_by("cash_flow", "period_end").alias("cash_flow"))


def fair_range(cash_flow: Column, shares: Column, price: Column, scenarios: Mapping[str, tuple[float, float, float]], years: int, base: str = "base") -> dict[str, Column]:
    """<scenario>_equity and <scenario>_per_share, implied_growth_pct, and ``reason`` and ``implied_reason`` where they are null.

    A scenario is (growth, discount, terminal growth), as fractions. Equity needs a positive cash flow, a share's part a share count.
    """
    positive = cash_flow > 0
    out: dict[str, Column] = {}
    for name, (growth, discount, terminal) in scenarios.items():
        equity = F.when(positive, discounted_value(cash_flow, F.lit(growth), discount, terminal, years))
        out |= {f"{name}_equity": equity, f"{name}_per_share": ratio(equity, shares)}
    cap = price * shares
    implied = F.when(positive, implied_growth(cap, cash_flow, *scenarios[base][1:], years))
    why = F.when(cash_flow.isNull(), "no cash flow").when(~positive, "cash flow is not positive")
    beyond = F.when(cap.isNull(), "no market value").when(implied.isNull(), "market value is out of the range of growth")
    return out | {"implied_growth_pct": 100 * implied, "reason": why, "implied_reason": F.coalesce(why, beyond)}


def revisions(estimates: DataFrame, as_of: Column, days: int) -> DataFrame:
    """From (security_id, period, as_of, value): change_pct of the newest estimated period since the first snapshot of the look-back, or a reason."""
    known = estimates.where(F.col("as_of") <= as_of)
    newest = known.groupBy("security_id").agg(F.max(F.struct("as_of", "period")).alias("__n")).select("security_id", F.col("__n.period").alias("period"))
    recent = F.when(F.col("as_of") >= F.date_sub(as_of, days), F.col("as_of"))
    seen = known.join(newest, ["security_id", "period"]).groupBy("security_id").agg(F.max("as_of").alias("last"), F.max_by("value", "as_of").alias("now"), F.min(recent).alias("first"), F.min_by("value", recent).alias("then"))
    lone = F.col("first").isNull() | (F.col("first") == F.col("last"))
    change = F.when(~lone & (F.col("then") != 0), (F.col("now") / F.col("then") - 1) * 100)
    return seen.select("security_id", change.alias("change_pct"), F.when(lone, "one snapshot").when(F.col("then") == 0, "earlier estimate is zero").alias("reason"))


def owner_change(quarters: DataFrame) -> DataFrame:
    """From (security_id, period_end, promoter_pct, pledged_pct), a quarter once: the last pledge, the change over four quarters, or a reason."""
    own = Window.partitionBy("security_id").orderBy("period_end")
    last = quarters.withColumns({"__before": F.lag("promoter_pct", 4).over(own), "__n": F.row_number().over(own)})
    found = last.groupBy("security_id").agg(*[F.max_by(c, "period_end").alias(c) for c in ("promoter_pct", "pledged_pct", "__before", "__n")])
    change = F.col("promoter_pct") - F.col("__before")
    return found.select("security_id", "pledged_pct", change.alias("change_4q"), F.when(F.col("__n") < 5, "fewer than five quarters").when(change.isNull(), "holding not reported").alias("reason"))


def ranked_ideas(verdicts: DataFrame, n: int) -> DataFrame:
    """The ``n`` best upward verdicts without a veto, with ``place``: by conviction, composite, symbol; fewer if fewer qualify."""
    level = F.array_position(F.array(*map(F.lit, CONVICTIONS)), F.col("conviction"))
    order = [F.when(level > 0, level).otherwise(len(CONVICTIONS) + 1), F.col("composite").desc_nulls_last(), F.col("symbol"), F.col("security_id")]
    best = verdicts.where(F.col("verdict").isin(*UPWARD) & ~F.col("vetoed")).orderBy(*order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows at most


def saving_of_direct(regular: Column, direct: Column, value: Column) -> dict[str, Column]:
    """gap_pct and saved_a_year of a direct plan, and why nothing is saved."""
    gap = regular - direct
    lacks = F.concat_ws(", ", F.when(regular.isNull(), "regular ratio"), F.when(direct.isNull(), "direct ratio"), F.when(value.isNull(), "value"))
    why = F.when(lacks != "", F.concat(F.lit("unknown: "), lacks)).when(gap <= 0, "direct is not cheaper")
    known = F.when(lacks == "", gap)
    return {"gap_pct": known, "saved_a_year": F.when(why.isNull(), F.bround(value * gap / 100, 2)), "reason": why}


def valued_lots(lots: DataFrame, funds: DataFrame, as_of: Column, oldest: int) -> DataFrame:
    """Lots (key, acquired, units, unit_cost) with holding_days, value, gain and reason by ``funds`` (key, held, nav, nav_date).

    No lot of a fund has a value if its units differ from those held by more than the tolerance, or its value is unknown or old.
    """
    units = lots.groupBy("key").agg(F.sum("units").alias("__units"))
    age = F.datediff(as_of, "nav_date")
    why = F.when(F.abs(F.col("__units") - F.col("held")) > UNIT_TOLERANCE, "lots differ from the holding").when(F.col("nav").isNull() | F.col("nav_date").isNull(), "no value a unit").when(age > oldest, "value a unit is old")
    state = units.join(funds, "key", "left").select("key", "nav", why.alias("reason"))
    value = F.when(F.col("reason").isNull(), F.col("units") * F.col("nav"))
    return lots.join(state, "key").select("key", "acquired", "units", F.datediff(as_of, "acquired").alias("holding_days"), value.alias("value"), (value - F.col("units") * F.col("unit_cost")).alias("gain"), "reason")


def analyse_funds(levels: DataFrame, days: int, mar_pct: float, least_pct: float = 80.0) -> DataFrame:
    """From (fund, date, nav, benchmark): points, coverage_pct, reason, and the figures of rolling returns and daily risk.

    What compares with the benchmark is null where it covers fewer than ``least_pct`` percent of a fund's days; it is
    measured between days that have both.
    """
    shared = levels.where("benchmark is not null")
    own = daily_risk(levels, mar_pct).select("fund", "std_pct", "sortino")
    down = daily_risk(shared, mar_pct).select("fund", "downside_capture_pct")
    counts = levels.groupBy("fund").agg(F.count("*").alias("points"), (100 * F.count("benchmark") / F.count("*")).alias("coverage_pct"))
    why = F.when(F.col("coverage_pct") == 0, "no benchmark").when(F.col("coverage_pct") < least_pct, "benchmark covers too few days")
    found = counts.join(own, "fund", "left").join(down, "fund", "left").join(rolling_returns(levels, days), "fund", "left").withColumn("reason", why)
    against = ("downside_capture_pct", "beat_pct", "median_excess_pct")
    return found.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in against})
