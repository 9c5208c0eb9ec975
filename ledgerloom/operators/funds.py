"""Funds: rolling returns, capture and Sortino, plan and option words, the category screen, what to do with a holding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import annual_growth, ratio
from ledgerloom.operators.screening import competition_rank

# Fixed values.
IDCW_WORDS = ["idcw", "dividend", "div", "payout", "reinvestment", "reinvest"]
PLAN_WORDS = ["direct", "dir", "regular", "plan", "growth", "option", "of"]


def rolling_starts(levels: DataFrame, days: int, *values: str) -> DataFrame:
    """Each point with the last one at least ``days`` days before it (``start_date``, ``start_<value>``).

    One pass over a fund's history in order; no pairs are formed. Points without such a start are left out.
    """
    day = F.datediff(F.col("date"), F.lit("1970-01-01"))
    until = Window.partitionBy("fund").orderBy(day).rangeBetween(Window.unboundedPreceding, -days)
    found = levels.withColumns({"start_date": F.last("date").over(until)} | {f"start_{v}": F.last(v).over(until) for v in values})
    return found.where("start_date is not null")


def rolling_returns(levels: DataFrame, days: int) -> DataFrame:
    """From (fund, date, nav, benchmark): windows, median, least and most percent a year, beat_pct, median_excess_pct.

    The benchmark's figures use points where it is known. Figures of fewer than two windows are null.
    """
    span = F.datediff("date", "start_date")
    own = rolling_starts(levels.where("nav > 0"), days, "nav").select("fund", annual_growth(F.col("start_nav"), F.col("nav"), span).alias("r"))
    both = rolling_starts(levels.where("nav > 0 and benchmark > 0"), days, "nav", "benchmark")
    gap = both.select("fund", (annual_growth(F.col("start_nav"), F.col("nav"), span) - annual_growth(F.col("start_benchmark"), F.col("benchmark"), span)).alias("d"))
    plain = own.groupBy("fund").agg(F.count("*").alias("windows"), F.median("r").alias("median"), F.min("r").alias("least"), F.max("r").alias("most"))
    against = gap.groupBy("fund").agg(F.count("*").alias("pairs"), F.avg((F.col("d") > 0).cast("double")).alias("beat"), F.median("d").alias("excess"))
    enough, paired = F.col("windows") >= 2, F.col("pairs") >= 2
    return plain.join(against, "fund", "left").select(
        "fund", "windows", *[F.when(enough, 100 * F.col(c)).alias(f"{c}_pct") for c in ("median", "least", "most")],
        F.when(paired, 100 * F.col("beat")).alias("beat_pct"), F.when(paired, 100 * F.col("excess")).alias("median_excess_pct"),
    )


def daily_risk(levels: DataFrame, mar_pct: float, year: int = 252) -> DataFrame:
    """From (fund, date, nav, benchmark): std_pct, downside_capture_pct (days the benchmark falls), sortino."""
    before = Window.partitionBy("fund").orderBy("date")
    moved = levels.select("fund", (ratio(F.col("nav"), F.lag("nav").over(before)) - 1).alias("f"), (ratio(F.col("benchmark"), F.lag("benchmark").over(before)) - 1).alias("b")).where("f is not null")
    short = F.least(F.col("f") - mar_pct / 100 / year, F.lit(0.0))
    down = F.col("b") < 0
    found = moved.groupBy("fund").agg(F.count("*").alias("n"), F.stddev_samp("f").alias("sd"), F.avg("f").alias("mean"), F.sqrt(F.avg(short * short)).alias("short"), F.avg(F.when(down, F.col("f"))).alias("fd"), F.avg(F.when(down, F.col("b"))).alias("bd"))
    sortino = F.when(F.col("n") >= 2, ratio(F.col("mean") * year - mar_pct / 100, F.col("short") * year**0.5))
    return found.select("fund", "n", (100 * F.col("sd") * year**0.5).alias("std_pct"), (100 * ratio(F.col("fd"), F.col("bd"))).alias("downside_capture_pct"), sortino.alias("sortino"))


def words(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))


def plan(name: Column) -> Column:
    """direct, regular, or null where the name doesn't say."""
    said = words(name)
    return F.when(F.arrays_overlap(said, F.array(F.lit("direct"), F.lit("dir"))), "direct").when(F.array_contains(said, "regular"), "regular")


def option(name: Column) -> Column:
    said = words(name)
    return F.when(F.arrays_overlap(said, F.array(*[F.lit(w) for w in IDCW_WORDS])), "idcw").when(F.array_contains(said, "growth"), "growth").otherwise("other")


def rejections(candidates: DataFrame, limits: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``candidates`` with ``rejected``: reasons in order, empty for those that stay.

    Columns plan, option, comparable and owned are read; ``limits`` gives a least (">=") or most ("<=") for others.
    """
    why = [
        F.when(F.col("plan").isNull(), "plan unknown").when(F.col("plan") != "direct", "not a direct plan"),
        F.when(F.col("option") == "idcw", "pays out").when(~F.coalesce("comparable", F.lit(False)), "returns not comparable"),
    ]
    for name, (sign, limit) in limits.items():
        bad = F.col(name) < limit if sign == ">=" else F.col(name) > limit
        why.append(F.when(F.col(name).isNull(), f"{name} unknown").when(bad, f"{name} fails"))
    why.append(F.when(F.col("owned"), "already owned"))
    return candidates.withColumn("rejected", F.array_compact(F.array(*why)))


def screen(candidates: DataFrame, ranks: Mapping[str, tuple[bool, float]], n: int = 5) -> DataFrame:
    """The ``n`` best of each category by weighted rank sums: (category, fund, score), lower first.

    ``ranks`` gives for each column whether less is better, and its weight; rows without a value rank after the last.
    """
    kept = candidates.where(F.size("rejected") == 0)
    ranked = kept.withColumns({f"__{c}": competition_rank(c, ascending, "category") for c, (ascending, _) in ranks.items()})
    score = sum((F.col(f"__{c}") * weight for c, (_, weight) in ranks.items()), F.lit(0.0))
    scored = ranked.select("category", "fund", F.bround(score, 4).alias("score"))
    place = F.row_number().over(Window.partitionBy("category").orderBy("score", "fund"))
    return scored.withColumn("place", place).where(F.col("place") <= n)


def plain_name(name: Column) -> Column:
    """The name's words without those of plan and option."""
    kept = F.filter(words(name), lambda w: ~w.isin(*IDCW_WORDS, *PLAN_WORDS))
    return F.array_join(kept, " ")


def direct_twins(schemes: DataFrame) -> DataFrame:
    """For each regular plan of (fund, amc, name): status (found, ambiguous, none), twin, candidates in order.

    A twin is a direct plan of the same plain name and option, and of the same house or one that isn't known. Direct
    plans are listed once for each plain name, option and house; schemes meet the list of their house and that of no
    house. All of a plain name are listed only where a regular plan's own house isn't known.
    """
    known = schemes.select("fund", F.lower("amc").alias("amc"), plain_name(F.col("name")).alias("__name"), option(F.col("name")).alias("__option"), plan(F.col("name")).alias("__plan"))
    kind = f"array<{schemes.schema['fund'].dataType.simpleString()}>"
    direct, regular = known.where("__plan = 'direct'"), known.where("__plan = 'regular'")
    key = ["__name", "__option"]
    listed = lambda rows, by, name: rows.groupBy(*by).agg(F.array_sort(F.collect_list("fund")).alias(name))
    none = F.array().cast(kind)
    groups = regular.select(*key, "amc").distinct()
    housed = groups.where("amc is not null").join(listed(direct.where("amc is not null"), [*key, "amc"], "__own"), [*key, "amc"], "left")
    housed = housed.join(listed(direct.where("amc is null"), key, "__free"), key, "left").select(*key, "amc", F.array_sort(F.concat(F.coalesce("__own", none), F.coalesce("__free", none))).alias("candidates"))
    free = groups.where("amc is null").select(*key).join(listed(direct.join(groups.where("amc is null").select(*key), key, "left_semi"), key, "candidates"), key, "left").select(*key, F.coalesce("candidates", none).alias("candidates"))
    met = regular.where("amc is not null").join(housed, [*key, "amc"]).unionByName(regular.where("amc is null").join(free, key), allowMissingColumns=True)
    n = F.size("candidates")
    return met.select("fund", F.when(n == 1, "found").when(n > 1, "ambiguous").otherwise("none").alias("status"), F.when(n == 1, F.get("candidates", F.lit(0))).alias("twin"), "candidates")


def tenure_years(since: Column, as_of: Column) -> Column:
    return F.when(since <= as_of, F.bround(F.datediff(as_of, since) / 365.0, 2))


#: The most or least of each figure that a fund may have.
LIMITS = {"ter_gap_pct": 0.0, "overlap_pct": 60.0, "beat_pct": 50.0, "median_excess_pct": 0.0, "downside_capture_pct": 100.0, "max_drawdown_pct": 35.0, "tenure_years": 2.0, "valuation_ratio": 1.25}
CORE = ["beat_pct", "median_excess_pct", "downside_capture_pct", "max_drawdown_pct"]


def diagnose(facts: DataFrame, limits: Mapping[str, float] = LIMITS) -> DataFrame:
    """``facts`` with ``action`` and ``reasons`` (code, metric, value, limit).

    Read are plan, twin_status, comparable, can_replace and the figures that ``limits`` names. The first rule that
    fires decides: a dearer twin, overlap, weak record (REPLACE, or REVIEW without a candidate), open questions. All
    reasons are listed, by rule and then by code and metric; for KEEP, the figures within their limits come first.
    """
    def reason(code: str, metric: str, on: Column, limit: bool = True, value: bool = True) -> Column:
        shown, bound = (F.col(metric).cast("double") if value else F.lit(None).cast("double")), F.lit(limits[metric] if limit else None).cast("double")
        return F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(metric).alias("metric"), shown.alias("value"), bound.alias("limit")))

    def listed(*reasons: Column) -> Column:
        return F.array_sort(F.array_compact(F.array(*reasons)))

    def above(metric: str) -> Column:
        return F.col(metric) > limits[metric]

    def below(metric: str) -> Column:
        return F.col(metric) < limits[metric]

    twin = (F.col("plan") == "regular") & (F.col("twin_status") == "found")
    comparable = F.coalesce("comparable", F.lit(False))
    dearer = listed(reason("TER_GAP_WITH_DIRECT_TWIN", "ter_gap_pct", twin & above("ter_gap_pct")))
    overlapping = listed(reason("OVERLAP_ABOVE_LIMIT", "overlap_pct", above("overlap_pct")))
    weak = listed(
        reason("BEAT_PCT_BELOW_MIN", "beat_pct", below("beat_pct")),
        reason("MEDIAN_EXCESS_BELOW_MIN", "median_excess_pct", below("median_excess_pct")),
        reason("DOWNSIDE_CAPTURE_ABOVE_MAX", "downside_capture_pct", above("downside_capture_pct")),
        reason("DRAWDOWN_ABOVE_MAX", "max_drawdown_pct", above("max_drawdown_pct")),
    )

    def missing(metric: str, on: Column) -> Column:
        return reason("METRIC_UNAVAILABLE", metric, on & F.col(metric).isNull(), limit=False)

    forcing = [
        reason("DIRECT_TWIN_AMBIGUOUS", "direct_twin", (F.col("plan") == "regular") & (F.col("twin_status") == "ambiguous"), False, False),
        reason("NOT_COMPARABLE", "comparable", ~comparable, False, False),
        *[missing(m, comparable) for m in CORE],
        missing("ter_gap_pct", twin),
        reason("MANAGER_TENURE_SHORT", "tenure_years", below("tenure_years")),
        reason("VALUATION_STRETCH", "valuation_ratio", above("valuation_ratio")),
    ]
    noted = [missing("tenure_years", F.lit(True)), missing("valuation_ratio", F.lit(True))]
    within = listed(*[reason("WITHIN_LIMITS", m, F.col(m).isNotNull()) for m in limits if m != "ter_gap_pct"])
    found = facts.withColumns({"__1": dearer, "__2": overlapping, "__3": weak, "__4": listed(*forcing, *noted), "__open": F.size(listed(*forcing)) > 0, "__within": within})
    fired = [F.size(f"__{k}") > 0 for k in (1, 2, 3)]
    replace = F.when(F.coalesce("can_replace", F.lit(False)), "REPLACE").otherwise("REVIEW")
    action = F.when(fired[0], "SWITCH_TO_DIRECT").when(fired[1], "CONSOLIDATE").when(fired[2], replace).when(F.col("__open"), "REVIEW").otherwise("KEEP")
    reasons = F.when(F.col("action") == "KEEP", F.concat("__within", "__4")).otherwise(F.concat("__1", "__2", "__3", "__4"))
    return found.withColumn("action", action).withColumn("reasons", reasons).drop("__1", "__2", "__3", "__4", "__open", "__within")
