"""Named metrics from stored inputs: what each needs, and one frame with the values and reasons of those that are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import mid_rank
from ledgerloom.operators import history, indicators, ratios, setups, valuation
from ledgerloom.operators.screening import Rule, screen

Inputs = Mapping[str, DataFrame]

# Items whose newest year is the fiscal year, years of growth, days of a year of growth, days of revisions.
ANCHORS, GROWTH_YEARS, YEAR_DAYS, REVISION_DAYS = ("revenue", "net_income"), 3, (330, 400), 90
ITEMS = (
    "revenue", "gross_profit", "operating_income", "depreciation_amortization", "pretax_income", "income_tax", "net_income", "interest_expense", "total_assets", "current_assets",
    "current_liabilities", "total_debt", "total_equity", "cash", "receivables", "inventory", "payables", "cfo", "capex", "eps", "shares_out",
)
TECHNICAL = (
    "sma_20", "sma_50", "sma_200", "ema_21", "slope_50dma_pct", "price_vs_sma200_pct", "rsi_14", "macd", "macd_signal", "macd_hist", "roc_3m", "roc_6m", "roc_12m", "dist_52w_high_pct",
    "dist_52w_low_pct", "atr_14", "atr_pct", "vol_20d", "vol_60d", "boll_width_20", "avg_volume_20", "updown_volume_ratio_20", "weekly_trend",
)
ALIASES = {"roce": "roce_pct", "roic": "roic_pct"}
# Example screens, to be tuned by their owner.
PRESETS: dict[str, tuple[Rule, ...]] = {
    "lt-quality-value": (Rule("quality_roe", "roe", ">=", 15, True), Rule("no_hard_red_flag", "hard_flag_count", "==", 0, True), Rule("not_expensive_vs_own_history", "valuation_percentile", "<=", 40), Rule("estimates_not_cut", "revisions", ">=", 0)),
    "lt-quality-growth": (Rule("quality_roe", "roe", ">=", 15, True), Rule("no_hard_red_flag", "hard_flag_count", "==", 0, True), Rule("revenue_growth", "revenue_cagr", ">=", 10), Rule("earnings_growth", "eps_cagr", ">=", 10), Rule("estimates_not_cut", "revisions", ">=", 0)),
    "pos-breakout": (Rule("sound_business", "roe", ">=", 10, True), Rule("breakout_setup", "base_breakout", "==", 1, True), Rule("relative_strength", "rs_percentile", ">=", 70)),
    "pos-pullback-uptrend": (Rule("sound_business", "roe", ">=", 10, True), Rule("above_200dma", "price_vs_sma200_pct", ">", 0, True), Rule("pullback_setup", "pullback_to_50dma", "==", 1, True)),
}


@dataclass(frozen=True)
class Metric:
    """``bundle`` computes it with others of its kind from the stored inputs that it ``needs``."""

    bundle: str
    needs: frozenset[str]


def annual_book(statements: DataFrame, as_of: str) -> DataFrame:
    """security_id, period_end and ``ITEMS`` of each year, as filed by a day; ``fy`` is the last year with an anchor item."""
    day = F.lit(as_of).cast("date")
    known = valuation.known_figures(statements.where("period_type = 'A'"), day)
    wide = known.groupBy("security_id", "period_end").agg(*[F.max(F.when(F.col("item") == i, F.col("value"))).alias(i) for i in ITEMS])
    anchored = F.when(F.coalesce(*ANCHORS).isNotNull(), F.col("period_end"))
    return wide.withColumn("capex", F.abs("capex")).withColumn("fy", F.max(anchored).over(Window.partitionBy("security_id")))


def _growth(book: DataFrame, item: str, years: int = GROWTH_YEARS) -> tuple[Column, Column]:
    """Aggregates over a security's ``book``: growth a year in percent over the last years that have the item, and why there is none."""
    points = F.reverse(F.array_sort(F.filter(F.collect_list(F.when(F.col(item).isNotNull(), F.struct(F.col("period_end").alias("d"), F.col(item).alias("v")))), lambda p: p.isNotNull())))
    last, first = F.get(points, F.lit(0)), F.get(points, F.lit(years))
    span = F.datediff(last["d"], first["d"])
    why = F.when(first.isNull(), f"need {years + 1} annual points").when(~span.between(YEAR_DAYS[0] * years, YEAR_DAYS[1] * years), "not consecutive fiscal years").when((first["v"] <= 0) | (last["v"] <= 0), "start and end must be positive")
    return F.when(why.isNull(), 100 * (F.pow(last["v"] / first["v"], F.lit(1.0 / years)) - 1)), why


def fundamentals(statements: DataFrame, as_of: str) -> DataFrame:
    """security_id with ratios of the fiscal year, return on average equity and growth, each with why_<metric>."""
    book = annual_book(statements, as_of)
    before = F.max_by("total_equity", F.when((F.col("period_end") < F.col("fy")) & F.col("total_equity").isNotNull(), F.col("period_end")))
    grown = {f"{i}_cagr": _growth(book, i) for i in ("revenue", "net_income", "eps")}
    by_security = book.groupBy("security_id").agg(before.alias("opening"), *[c for n, (v, w) in grown.items() for c in (v.alias(n), w.alias(f"why_{n}"))])
    year = book.where("period_end = fy").join(by_security, "security_id", "right")
    opening, closing = F.col("opening"), F.col("total_equity")
    no_year = F.when(F.col("fy").isNull(), "no annual statements")
    why = F.coalesce(no_year, F.when(F.col("net_income").isNull() | closing.isNull(), "no net_income or total_equity").when(opening.isNull(), "no prior-year equity").when((closing <= 0) | (opening <= 0), "equity is not positive"))
    cells = {"roe": (F.when(why.isNull(), 100 * F.col("net_income") / ((opening + closing) / 2)), why)}
    cells |= {n: (v, F.coalesce(no_year, w)) for n, (v, w) in ratios.general().items()}
    margin = F.coalesce(no_year, F.when(F.col("net_income").isNull() | F.col("revenue").isNull(), "no net_income or revenue").when(F.col("revenue") == 0, "revenue is zero"))
    cells["net_margin_pct"] = (F.when(margin.isNull(), 100 * F.try_divide(F.col("net_income"), F.col("revenue"))), margin)
    cells |= {a: cells[n] for a, n in ALIASES.items()}
    return year.select("security_id", *[c for n, (v, w) in cells.items() for c in (v.alias(n), w.alias(f"why_{n}"))], *[c for n in grown for c in (n, f"why_{n}")])


def _technical(inputs: Inputs, as_of: str) -> DataFrame:
    cells = _all_cells(inputs, as_of)
    return cells.select("security_id", *[c for n in (*TECHNICAL, "rs_benchmark_change_6m_pct", "rs_sector_change_6m_pct") for c in (F.col(n).cast("double").alias(n), F.when(F.col(n).isNull(), "too few bars").alias(f"why_{n}"))])


def _all_cells(inputs: Inputs, as_of: str) -> DataFrame:
    day = F.lit(as_of).cast("date")
    bars = inputs["bars"].where(F.col("date") <= day)
    none = lambda schema: bars.sparkSession.createDataFrame([], schema)
    kind = bars.schema["security_id"].dataType.simpleString()
    return indicators.all_cells(bars, inputs.get("benchmark", none("date date, benchmark double")), inputs.get("sector_bars", none(f"security_id {kind}, date date, sector_close double")))


def _universe(inputs: Inputs, as_of: str) -> DataFrame:
    ranked = _all_cells(inputs, as_of).select("security_id", mid_rank(F.col("rs_benchmark_change_6m_pct")).alias("rs_percentile"))
    return ranked.withColumn("why_rs_percentile", F.when(F.col("rs_percentile").isNull(), "no relative strength"))


def _valued(inputs: Inputs, as_of: str) -> DataFrame:
    """Multiples, market value, the first percentile of pe and pb in their own history, and pe against its peers' median."""
    closes, securities = inputs["closes"], inputs["securities"]
    found = history.valuation_history(inputs["statements"], closes, securities, as_of)
    pick = lambda m, c: F.max(F.when(F.col("multiple") == m, F.col(c)))
    wide = found.groupBy("security_id").agg(*[c for m in history.MULTIPLES for c in (pick(m, "current").alias(m), pick(m, "reason").alias(f"why_{m}"))], F.coalesce(pick("pe", "percentile_5y"), pick("pb", "percentile_5y")).alias("valuation_percentile"), F.concat_ws("; ", pick("pe", "reason_5y"), pick("pb", "reason_5y")).alias("why"))
    day = F.lit(as_of).cast("date")
    last = closes.where((F.col("date") <= day) & F.col("close").isNotNull()).groupBy("security_id").agg(F.max_by("close", "date").alias("close"))
    at = last.select("security_id", F.lit(0).alias("month"), day.alias("date"), "close")
    shares = valuation.known_figures(inputs["statements"].where("item = 'shares_out'"), day).groupBy("security_id").agg(F.max_by("value", F.struct("period_end", (F.col("period_type") == "A").cast("int"))).alias("shares_out"))
    both = wide.join(at, "security_id").join(shares, "security_id", "left").withColumns({"market_cap": F.col("close") * F.col("shares_out"), "why_market_cap": F.when(F.col("shares_out").isNull(), "no shares_out filed"), "why_valuation_percentile": F.when(F.col("valuation_percentile").isNull(), F.col("why"))})
    peers = both.join(securities.select("security_id", "sector_kind"), "security_id", "left")
    median = peers.where("pe is not null").groupBy("sector_kind").agg(F.median("pe").alias("peer_pe"))
    gap = F.bround(100 * (F.try_divide(F.col("pe"), F.col("peer_pe")) - 1), 8)
    return peers.join(median, "sector_kind", "left").withColumns({"pe_vs_peer_median_pct": gap, "why_pe_vs_peer_median_pct": F.when(gap.isNull(), F.coalesce("why_pe", F.lit("no peer median")))})


def _estimates(inputs: Inputs, as_of: str) -> DataFrame:
    found = valuation.revisions(inputs["estimates"], F.lit(as_of).cast("date"), REVISION_DAYS)
    return found.select("security_id", F.col("change_pct").alias("revisions"), F.col("reason").alias("why_revisions"))


def _setups(inputs: Inputs, as_of: str) -> DataFrame:
    found = setups.setups(inputs["bars"].where(F.col("date") <= F.lit(as_of).cast("date")))
    is_one = lambda name: F.when(F.col("setup").isNotNull(), (F.col("setup") == name).cast("double"))
    cells = {"setup_type": F.col("setup"), "base_breakout": is_one("breakout"), "pullback_to_50dma": is_one("pullback")}
    return found.select("security_id", *[c for n, v in cells.items() for c in (v.alias(n), F.when(F.col("setup").isNull(), F.col("reason")).alias(f"why_{n}"))])


def _flags(inputs: Inputs, as_of: str) -> DataFrame:
    """``flags``: security_id, severity, state, as other operators found them."""
    fired = lambda s: F.sum(((F.col("severity") == s) & (F.col("state") == "fired")).cast("int")).cast("double")
    counted = inputs["flags"].groupBy("security_id").agg(fired("hard").alias("hard_flag_count"), fired("soft").alias("soft_flag_count"))
    return counted.withColumns({"why_hard_flag_count": F.lit(None).cast("string"), "why_soft_flag_count": F.lit(None).cast("string")})


BUNDLES: dict[str, Callable[[Inputs, str], DataFrame]] = {
    "technical": _technical, "universe": _universe, "fundamentals": lambda inputs, as_of: fundamentals(inputs["statements"], as_of), "valuation": _valued, "estimates": _estimates, "setups": _setups, "flags": _flags,
}


def _registry() -> dict[str, Metric]:
    valued, booked = frozenset(("statements", "closes", "securities")), frozenset(("statements",))
    out = {n: Metric("technical", frozenset(("bars",))) for n in TECHNICAL}
    out |= {"rs_benchmark_change_6m_pct": Metric("technical", frozenset(("bars", "benchmark"))), "rs_sector_change_6m_pct": Metric("technical", frozenset(("bars", "sector_bars")))}
    out |= {n: Metric("fundamentals", booked) for n in ("roe", "net_margin_pct", *ratios.general(), *ALIASES, "revenue_cagr", "net_income_cagr", "eps_cagr")}
    out |= {n: Metric("valuation", valued) for n in (*history.MULTIPLES, "market_cap", "valuation_percentile", "pe_vs_peer_median_pct")}
    out |= {n: Metric("setups", frozenset(("bars",))) for n in ("setup_type", "base_breakout", "pullback_to_50dma")}
    out |= {n: Metric("flags", frozenset(("flags",))) for n in ("hard_flag_count", "soft_flag_count")}
    return out | {"rs_percentile": Metric("universe", frozenset(("bars", "benchmark"))), "revisions": Metric("estimates", frozenset(("estimates",)))}


def registry() -> dict[str, Metric]:
    """Every metric by name. Ratios are columns, so this needs a running session."""
    return _registry()


def inputs_needed(names: Iterable[str]) -> set[str]:
    known = registry()
    return set().union(*(known[n].needs for n in names))


def bundles_needed(names: Iterable[str]) -> set[str]:
    known = registry()
    return {known[n].bundle for n in names}


def metric_values(securities: DataFrame, inputs: Inputs, names: Sequence[str], as_of: str) -> DataFrame:
    """security_id, and each named metric with why_<metric>, for every row of ``securities``.

    Only the bundles that the names belong to are computed, and of their columns Catalyst keeps those that are named. A
    metric whose inputs aren't given, or whose bundle has no row of a security, is null with a reason. Unknown names are
    an error. Inputs: bars, benchmark (date, benchmark), sector_bars, statements, closes, securities (security_id, market,
    sector_kind), estimates, flags.
    """
    known = registry()
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    out = securities.select("security_id").distinct()
    for bundle in dict.fromkeys(known[n].bundle for n in names):
        own = [n for n in names if known[n].bundle == bundle]
        lacking = {n: sorted(known[n].needs - set(inputs)) for n in own}
        given = [n for n in own if not lacking[n]]
        if given:
            found = BUNDLES[bundle](inputs, as_of).select("security_id", F.lit(True).alias("known"), *[c for n in given for c in (n, f"why_{n}")])
            whys = {f"why_{n}": F.when(F.col("known").isNull(), f"no {bundle} rows").otherwise(F.col(f"why_{n}")) for n in given}
            out = out.join(found, "security_id", "left").withColumns(whys).drop("known")
        for n in own:
            if lacking[n]:
                out = out.withColumns({n: F.lit(None).cast("double"), f"why_{n}": F.lit(f"{', '.join(lacking[n])} not loaded")})
    return out.select("security_id", *[c for n in names for c in (n, f"why_{n}")])


def run_screen(securities: DataFrame, inputs: Inputs, rules: Sequence[Rule], as_of: str) -> DataFrame:
    """``screen`` over exactly the metrics that the rules read."""
    return screen(metric_values(securities, inputs, list(dict.fromkeys(r.metric for r in rules)), as_of), rules)
