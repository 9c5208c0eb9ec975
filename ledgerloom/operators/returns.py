"""What holdings returned: amounts at the rate of a day, dated lots, money-weighted returns one by one and pooled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.pit import effective_rows
from ledgerloom.operators.portfolio import xirr
from ledgerloom.operators.stored import cover

# Days after which a price, a lot's rate, and the rate of a valuation are too old.
PRICE_AGE, LOT_RATE_AGE, VALUATION_RATE_AGE = 10, 7, 30


def daily_rates(rates: DataFrame, oldest: int) -> DataFrame:
    """date, rate, rate_date of every day that has a positive rate at most ``oldest`` days before; one currency, so bounded by days."""
    after = F.coalesce(F.date_sub(F.lead("date").over(Window.orderBy("date")), 1), F.date_add("date", oldest))
    until = rates.where("rate > 0").withColumn("__until", F.least(after, F.date_add("date", oldest)))
    return until.select(F.explode(F.sequence("date", "__until")).alias("day"), "rate", F.col("date").alias("rate_date")).withColumnRenamed("day", "date")


def convert(holdings: DataFrame, rates: DataFrame, on: str, foreign: str = "USD", stale_days: int = 10, oldest: int = VALUATION_RATE_AGE) -> DataFrame:
    """``holdings`` (value, currency, date ``on``) with rate, stale and value_home by the last positive rate on or before the day.

    ``rates`` is (date, rate), a day once. Home currency rows keep their value; foreign ones have none without a rate or
    with one more than ``oldest`` days old.
    """
    daily = daily_rates(rates, oldest).select(F.col("date").alias("__on"), F.col("rate").alias("__rate"), F.col("rate_date").alias("__at"))
    known = holdings.join(daily, holdings[on] == daily["__on"], "left")
    is_foreign = F.col("currency") == foreign
    rate = F.when(is_foreign, F.col("__rate"))
    value = F.when(is_foreign, F.col("value") * rate).otherwise(F.col("value"))
    return known.select(*holdings.columns, rate.alias("rate"), (rate.isNotNull() & (F.datediff(on, "__at") > stale_days)).alias("stale"), value.alias("value_home"))


def usable_price(price: Column, day: Column, valuation: Column, oldest: int = PRICE_AGE) -> Column:
    """The price, unless it is not positive, of a later day, or more than ``oldest`` days old."""
    return F.when((price > 0) & (day <= valuation) & (F.datediff(valuation, day) <= oldest), price)


def lot_lines(lots: DataFrame, valuation: Column, long_days: int | None) -> DataFrame:
    """Each lot with its holding_days and long_term, which is null where no threshold is set."""
    days = F.datediff(valuation, "acquired")
    return lots.withColumns({"holding_days": days, "long_term": F.lit(None).cast("boolean") if long_days is None else days >= long_days})


def lot_flows(lots: DataFrame, holdings: DataFrame, valuation: Column) -> DataFrame:
    """key, date, amount: each lot's cost paid on its day, and on the valuation day what all of the key's lots are worth.

    ``lots`` is (key, acquired, quantity, cost), ``holdings`` (key, held, price, price_date), a key once. Keys whose lots
    exceed what is held, and keys without a usable price, have no flows.
    """
    states = lot_states(lots, holdings, valuation)
    open_keys = states.where("state in ('exact', 'partial') and usable is not null").select("key", (F.col("covered") * F.col("usable")).alias("worth"))
    paid = lots.join(open_keys.select("key"), "key").select("key", F.col("acquired").alias("date"), (-F.col("quantity") * F.col("cost")).alias("amount"))
    return paid.unionByName(open_keys.select("key", valuation.alias("date"), F.col("worth").alias("amount")))


def lot_states(lots: DataFrame, holdings: DataFrame, valuation: Column) -> DataFrame:
    """key, held, covered, state (none, partial, exact, over), usable (price or null) of every key held or with lots."""
    sums = lots.groupBy("key").agg(F.sum("quantity").alias("covered"), F.count("*").alias("lots"))
    both = holdings.join(sums, "key", "full_outer")
    state = F.when(F.col("lots").isNull(), "none").otherwise(cover(F.col("covered"), F.coalesce("held", F.lit(0))))
    return both.select("key", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("covered", F.lit(0)).alias("covered"), state.alias("state"), usable_price(F.col("price"), F.col("price_date"), valuation).alias("usable"))


def lot_report(lots: DataFrame, holdings: DataFrame, valuation: Column) -> DataFrame:
    """key, state, rate, reason: the money-weighted return of each key's dated lots, or why there is none."""
    rates = xirr(lot_flows(lots, holdings, valuation), "key").withColumnRenamed("reason", "__why")
    known = lot_states(lots, holdings, valuation).join(rates, "key", "left")
    why = F.when(F.col("state") == "none", "no lot dates").when(F.col("state") == "over", "lots exceed the holding").when(F.col("usable").isNull(), "no recent price").otherwise(F.col("__why"))
    return known.select("key", "state", "rate", why.alias("reason"))


def home_flows(flows: DataFrame, rates: DataFrame, valuation: Column) -> DataFrame:
    """Foreign flows at the rate of their own days, the worth at that of the valuation, which may be older. A key that
    lacks one of its rates has no flows at all."""
    marked = flows.withColumnRenamed("amount", "value").withColumn("currency", F.lit("USD"))
    last = marked.where(F.col("date") == valuation)
    priced = convert(marked.where(F.col("date") != valuation), rates, "date", oldest=LOT_RATE_AGE).unionByName(convert(last, rates, "date"))
    lacks = F.max(F.col("value_home").isNull()).over(Window.partitionBy("key"))
    return priced.withColumn("__lacks", lacks).where("not __lacks").select("key", "date", F.col("value_home").alias("amount"))


def pooled_return(flows: DataFrame, values: DataFrame, group: str = "portfolio") -> DataFrame:
    """``group``, rate, reason, coverage_pct: the return of all flows of keys with exact lots, and their share of the value.

    ``flows`` is (``group``, key, date, amount), ``values`` (``group``, key, value, state), a key once in each group. Flows of one
    day are added, so what one array holds is bounded by the days.
    """
    exact = values.where("state = 'exact'").select(group, "key")
    daily = flows.join(exact, [group, "key"], "left_semi").groupBy(group, "date").agg(F.sum("amount").alias("amount"))
    share = values.groupBy(group).agg(F.sum("value").alias("all"), F.sum(F.when(F.col("state") == "exact", F.col("value"))).alias("exact"))
    pct = F.when(F.col("all") != 0, 100 * F.coalesce("exact", F.lit(0)) / F.col("all"))
    found = share.join(xirr(daily, group), group, "left")
    reason = F.when(F.col("exact").isNull(), "no holding has exact lots").otherwise(F.col("reason"))
    return found.select(group, "rate", reason.alias("reason"), pct.alias("coverage_pct"))


def trailing_year(points: DataFrame, key: str, value: str) -> DataFrame:
    """key, pct: the last value against the last one at least 365 days before it; null where the series is shorter."""
    last = F.max("date").over(Window.partitionBy(key))
    marked = points.withColumn("__last", last).groupBy(key).agg(F.max_by(value, "date").alias("now"), F.max_by(value, F.when(F.datediff("__last", "date") >= 365, F.col("date"))).alias("then"))
    return marked.select(key, F.bround(F.when(F.col("then") != 0, 100 * (F.col("now") / F.col("then") - 1)), 2).alias("pct"))


def sold_in_year(decisions: DataFrame, calls: DataFrame, year: int, rate: float) -> DataFrame:
    """One row: amount and rows of what was sold on SELL and TRIM calls in a year, foreign trades at ``rate``.

    Skipped decisions don't count, nor, if there is a column ``corrects_id`` (and ``id``), those that a later row corrects.
    """
    value = F.coalesce(F.col("qty") * F.col("price"), F.lit(0)) * F.when(F.col("currency") == "USD", rate).otherwise(1.0)
    known = effective_rows(decisions) if "corrects_id" in decisions.columns else decisions
    kept = known.where((F.col("decision") != "skipped") & (F.year("on_date") == year)).join(calls.where(F.col("verdict").isin("SELL", "TRIM")).select("entry_id"), "entry_id", "left_semi")
    return kept.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("amount"), F.count("*").alias("rows"))


def tax_impact(lots: DataFrame, long_days: int | None, short_pct: float | None, long_pct: float | None) -> DataFrame:
    """From (key, holding_days, gain): key, gain, tax, reason; a total is null if one of its lots has none.

    ``reason`` is the first by name of what lots lack: a gain, a threshold, or the rate of their term.
    """
    term = F.lit(None).cast("boolean") if long_days is None else F.col("holding_days") >= long_days
    rate = F.when(term, F.lit(long_pct).cast("double")).when(~term, F.lit(short_pct).cast("double"))
    why = F.when(F.col("gain").isNull(), "gain unknown").when(term.isNull(), "long-term threshold not set").when(rate.isNull(), F.when(term, "long-term rate not set").otherwise("short-term rate not set"))
    lines = lots.withColumns({"__why": why, "__tax": F.greatest(F.col("gain"), F.lit(0.0)) * rate / 100}).withColumn("__tax", F.when(F.col("__why").isNull(), F.col("__tax")))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    return lines.groupBy("key").agg(whole("gain").alias("gain"), whole("__tax").alias("tax"), F.min("__why").alias("reason"))
