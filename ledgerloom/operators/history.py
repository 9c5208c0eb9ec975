"""Multiples at each month end from what was filed by then, and where today's value stands in its own history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.valuation import TTM_SPAN

# Items of which the newest of any period counts, items of which the newest year counts, the multiples.
NEWEST, YEARLY = ("shares_out", "total_equity", "total_debt", "cash"), ("eps", "operating_income", "depreciation_amortization", "cfo", "capex", "dividends_per_share")
MULTIPLES = ("pe", "pb", "ev_ebitda", "fcf_yield_pct", "dividend_yield_pct")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def _dated(filings: DataFrame) -> DataFrame:
    """Rows with the day from which they can be seen: filed, and their period over."""
    known = filings.where(F.col("value").isNotNull() & F.col("filed_at").isNotNull() & F.col("period_end").isNotNull())
    return known.withColumn("seen_from", F.greatest("filed_at", "period_end"))


def _cut(versions: DataFrame, months: DataFrame) -> DataFrame:
    """Versions in force at month ends: each is laid out over the months of its interval, then held against their days.

    An interval ends before ``until``, or with the last month there is; so a row meets only the months it can be in
    force in, by an equal-key join.
    """
    span = months.groupBy("security_id").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    laid = versions.join(span, "security_id").withColumns({"from_month": F.greatest(_month(F.col("seen_from")), F.col("first")), "to_month": F.least(F.coalesce(_month(F.col("until")), F.col("last")), F.col("last"))})
    laid = laid.where("from_month <= to_month").withColumn("month", F.explode(F.sequence("from_month", "to_month"))).drop("first", "last", "from_month", "to_month")
    return laid.join(months.select("security_id", "month", "date"), ["security_id", "month"]).where((F.col("seen_from") <= F.col("date")) & (F.col("until").isNull() | (F.col("until") > F.col("date"))))


def _newest_in_force(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with ``until``: the first day on which one of a later period, or a later filing of the same, can be seen."""
    order = Window.partitionBy("security_id", *keys).orderBy(F.desc("period_end"), F.desc("yearly"), F.desc("filed_at"), F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("until", F.min("seen_from").over(order))


def trailing_eps(filings: DataFrame, months: DataFrame) -> DataFrame:
    """security_id, month, eps: the sum of the last four quarters known at each month end, if they span three quarters.

    A quarter may count until each of the next four can be seen; of those in force at a month end, the last four do.
    """
    quarters = _dated(filings.where("item = 'eps' and period_type <> 'A'")).select("security_id", "period_end", "filed_at", "seen_from", "value")
    later = Window.partitionBy("security_id", "period_end").orderBy(F.desc("filed_at"), F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    versions = quarters.withColumn("replaced", F.min("seen_from").over(later))
    periods = quarters.groupBy("security_id", "period_end").agg(F.min("seen_from").alias("first_seen"))
    after = Window.partitionBy("security_id").orderBy("period_end").rowsBetween(1, 4)
    periods = periods.withColumn("passed", F.when(F.count("first_seen").over(after) == 4, F.max("first_seen").over(after))).drop("first_seen")
    held = _cut(versions.join(periods, ["security_id", "period_end"]).withColumn("until", F.least("replaced", "passed")), months)
    turn = F.row_number().over(Window.partitionBy("security_id", "month").orderBy(F.desc("period_end")))
    last = held.withColumn("turn", turn).where("turn <= 4").groupBy("security_id", "month").agg(F.count("*").alias("n"), F.sum("value").alias("eps"), F.datediff(F.max("period_end"), F.min("period_end")).alias("span"))
    return last.where((F.col("n") == 4) & F.col("span").between(*TTM_SPAN)).select("security_id", "month", "eps")


def facts_at(filings: DataFrame, months: DataFrame) -> DataFrame:
    """``months`` (security_id, date, close, month) with the figures that were known at each of these days."""
    dated = _dated(filings).withColumn("yearly", (F.col("period_type") == "A").cast("int"))
    newest = _newest_in_force(dated.where(F.col("item").isin(*NEWEST)), ["item"])
    annual = _newest_in_force(dated.where(F.col("item").isin(*YEARLY) & (F.col("yearly") == 1)), ["item"])
    columns = ["security_id", "item", "value", "seen_from", "until"]
    held = _cut(newest.select(*columns).unionByName(annual.select(*columns)), months)
    wide = held.groupBy("security_id", "month").agg(*[F.max(F.when(F.col("item") == i, F.col("value"))).alias(i) for i in (*NEWEST, *YEARLY)])
    both = months.join(wide, ["security_id", "month"], "left").join(trailing_eps(filings, months).withColumnRenamed("eps", "ttm"), ["security_id", "month"], "left")
    basis = F.when(F.col("ttm").isNotNull(), "ttm").when(F.col("eps").isNotNull(), "last_annual")
    return both.withColumns({"eps_basis": basis, "eps": F.coalesce("ttm", "eps"), "capex": F.abs("capex")}).drop("ttm")


def multiples_at(price: Column, market: Column, kind: Column) -> dict[str, tuple[Column, Column]]:
    """Each multiple of a row of ``facts_at``, with the reason why there is none."""
    c = F.col
    cap, ebitda = price * c("shares_out"), c("operating_income") + c("depreciation_amortization")
    no_cap, financial = F.when(cap.isNull(), "no shares_out filed"), F.when(kind == "financial", "not meaningful for financials")
    lacking = F.when(c("operating_income").isNull() | c("depreciation_amortization").isNull() | c("total_debt").isNull() | c("cash").isNull(), "a part of EV or EBITDA is not filed")
    whys = {
        "pe": F.when(c("eps").isNull(), "no eps filed").when(c("eps") <= 0, "eps is not positive"),
        "pb": F.coalesce(no_cap, F.when(c("total_equity").isNull(), "no total_equity filed").when(c("total_equity") <= 0, "equity is not positive")),
        "ev_ebitda": F.coalesce(financial, no_cap, F.when(market == "IN", "operating income is after depreciation"), lacking, F.when(ebitda <= 0, "EBITDA is not positive")),
        "fcf_yield_pct": F.coalesce(financial, no_cap, F.when(c("cfo").isNull() | c("capex").isNull(), "no cfo and capex filed"), F.when(cap == 0, "no price")),
        "dividend_yield_pct": F.when(c("dividends_per_share").isNull(), "no dividends_per_share filed").when(price == 0, "no price"),
    }
    value = {
        "pe": F.try_divide(price, c("eps")), "pb": F.try_divide(cap, c("total_equity")), "ev_ebitda": F.try_divide(cap + c("total_debt") - c("cash"), ebitda),
        "fcf_yield_pct": F.try_divide(100 * (c("cfo") - c("capex")), cap), "dividend_yield_pct": F.try_divide(100 * c("dividends_per_share"), price),
    }
    return {m: (F.when(whys[m].isNull(), F.bround(value[m], 8)), whys[m]) for m in MULTIPLES}


def valuation_history(filings: DataFrame, closes: DataFrame, securities: DataFrame, as_of: str, years: Sequence[int] = (5, 10), least: int = 24, slack: int = 62) -> DataFrame:
    """security_id, multiple, current, reason, and for each window observations_<n>y, median_<n>y, percentile_<n>y, reason_<n>y.

    ``filings``: security_id, item, period_type ('A' a year), period_end, value, filed_at; ``closes``: security_id, date,
    close; ``securities``: security_id, market, sector_kind. Each month's last close up to ``as_of`` is set against what
    was filed, of periods over, by that day; the last close of all against what was filed by ``as_of``. A window counts
    with ``least`` observations, the first of them at most ``slack`` days after its start; the percentile is the share of
    observations at or below the current value. Securities without a close have no rows, without filings only reasons;
    of two filings of one day the larger value counts.
    """
    day = F.lit(as_of).cast("date")
    seen = closes.where((F.col("date") <= day) & F.col("close").isNotNull())
    ends = seen.groupBy("security_id", _month(F.col("date")).alias("month")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close")).withColumn("at", F.lit("month"))
    # today is one more month: after all others, with the last close and the day as it is
    today = seen.groupBy("security_id").agg(F.max_by("close", "date").alias("close")).select("security_id", (_month(day) + 1).alias("month"), day.alias("date"), "close", F.lit("now").alias("at"))
    filed = filings.where((F.col("filed_at") <= day) & (F.col("period_end") <= day))
    known = facts_at(filed, ends.unionByName(today)).join(securities.select("security_id", "market", "sector_kind"), "security_id", "left")
    cells = multiples_at(F.col("close"), F.coalesce("market", F.lit("")), F.coalesce("sector_kind", F.lit("")))
    long = known.select("security_id", "date", "at", F.explode(F.array(*[F.struct(F.lit(m).alias("multiple"), v.alias("value"), w.alias("why")) for m, (v, w) in cells.items()])).alias("c")).select("security_id", "date", "at", "c.*")
    now = long.where("at = 'now'").select("security_id", "multiple", F.col("value").alias("current"), F.col("why").alias("reason"))
    past = long.where("at = 'month' and value is not null").join(now.select("security_id", "multiple", "current"), ["security_id", "multiple"])
    measures = []
    for n in years:
        inside = F.col("date") > F.add_months(day, -12 * n)
        measures += [F.count(F.when(inside, 1)).alias(f"n{n}"), F.min(F.when(inside, F.col("date"))).alias(f"first{n}"), F.median(F.when(inside, F.col("value"))).alias(f"m{n}"), F.count(F.when(inside & (F.col("value") <= F.col("current")), 1)).alias(f"below{n}")]
    found = now.join(past.groupBy("security_id", "multiple").agg(*measures), ["security_id", "multiple"], "left")
    out = []
    for n in years:
        count = F.coalesce(f"n{n}", F.lit(0).cast("long"))
        why = F.when(count < least, "too few observations").when(F.col(f"first{n}") > F.date_add(F.add_months(day, -12 * n), slack), "history is shorter than the window")
        out += [count.alias(f"observations_{n}y"), F.when(why.isNull(), F.bround(F.col(f"m{n}"), 8)).alias(f"median_{n}y"), F.when(why.isNull() & F.col("current").isNotNull(), F.bround(F.try_divide(100 * F.col(f"below{n}"), count), 8)).alias(f"percentile_{n}y"), F.coalesce(why, F.when(F.col("current").isNull(), "no current value")).alias(f"reason_{n}y")]
    return found.select("security_id", "multiple", "current", "reason", *out)
