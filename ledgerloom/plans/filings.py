"""Queries over filings, multiples, flags, reviews, lots and names. Nations are companies; customers, orders and lines are cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.stats import r6
from ledgerloom.operators import fundamentals as fu
from ledgerloom.operators import names, review, schedule
from ledgerloom.plans.bindings import BARS, bars
from ledgerloom.plans.registry import query, table

_FACTS = """v AS (SELECT c_nationkey AS security_id, o_orderstatus AS item, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
  c AS (SELECT security_id, item, q, make_date(y, 1, 1) AS start, last_day(make_date(y, 3 * q, 1)) AS "end", (sum(v) OVER (PARTITION BY security_id, item, y ORDER BY q))::DOUBLE AS value FROM v),
  k AS (SELECT security_id, CASE item WHEN 'P' THEN 'capex' WHEN 'F' THEN 'revenue' ELSE 'cash' END AS item, q, CASE WHEN item <> 'O' THEN start END AS start, "end", CASE WHEN item = 'P' THEN -value ELSE value END AS value FROM c),
  facts AS (SELECT *, 0 AS rank, "end" + 40 AS filed, q = 4 AS annual_form FROM k
    UNION ALL SELECT * REPLACE (CASE WHEN security_id % 2 = 1 THEN value * 1.01::DOUBLE ELSE value END AS value), 0, "end" + 405, q = 4 FROM k
    UNION ALL SELECT * REPLACE (value * 2 AS value), 1, "end" + 30, q = 4 FROM k)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of orders since the start of the year, filed, filed again (odd companies restate), and under a lesser concept."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("security_id")), "o_custkey")
    by_quarter = orders.groupBy("security_id", F.col("o_orderstatus").alias("item"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    so_far = F.expr("cast(sum(v) over (partition by security_id, item, y order by q) as double)")
    kept = by_quarter.withColumn("v", so_far).selectExpr(
        "security_id", "case item when 'P' then 'capex' when 'F' then 'revenue' else 'cash' end as item", "q", "case when item <> 'O' then make_date(y, 1, 1) end as start", "last_day(make_date(y, 3 * q, 1)) as end", "case when item = 'P' then -v else v end as value",
    )
    filings = F.array(*[F.struct(F.lit(rank).alias("rank"), value.alias("value"), F.date_add("end", lag).alias("filed")) for rank, value, lag in ((0, F.col("value"), 40), (0, F.when(F.col("security_id") % 2 == 1, F.col("value") * 1.01).otherwise(F.col("value")), 405), (1, F.col("value") * 2, 30))])
    return kept.select("security_id", "item", "start", "end", (F.col("q") == 4).alias("annual_form"), F.inline(filings))


@query(
    "st_quarterise",
    f"""WITH {_FACTS}, t AS (SELECT *, date_diff('day', start, "end") AS n FROM facts QUALIFY rank = min(rank) OVER (PARTITION BY security_id, item, start, "end")),
    d AS (SELECT *, CASE WHEN start IS NULL THEN 'instant' WHEN n BETWEEN 350 AND 380 THEN 'A' WHEN n BETWEEN 80 AND 100 THEN 'Q' WHEN n BETWEEN 170 AND 190 OR n BETWEEN 260 AND 285 THEN 'YTD' ELSE 'other' END AS kind FROM t),
    direct AS (SELECT security_id, item, 'Q' AS period_type, "end" AS period_end, value, filed FROM d WHERE kind IN ('instant', 'Q') UNION ALL SELECT security_id, item, 'A', "end", value, filed FROM d WHERE kind = 'A' OR (kind = 'instant' AND annual_form)),
    s AS (SELECT security_id, item, start, "end", max_by(value, filed) AS value, max(filed) AS filed, bool_or(kind = 'Q') AS q FROM d WHERE kind IN ('A', 'Q', 'YTD') GROUP BY ALL),
    l AS (SELECT *, lag(value) OVER w AS v0, lag(filed) OVER w AS f0, bool_or(q) OVER (PARTITION BY security_id, item, "end") AS told FROM s WINDOW w AS (PARTITION BY security_id, item, start ORDER BY "end")),
    r AS (SELECT * FROM direct UNION ALL SELECT security_id, item, 'Q', "end", value - v0, greatest(filed, f0) FROM l WHERE v0 IS NOT NULL AND NOT told),
    a AS (SELECT security_id, item, period_type, period_end, CASE WHEN item = 'capex' THEN abs(value) ELSE value END AS value, filed AS filed_at FROM r),
    z AS (SELECT *, lag(value) OVER (PARTITION BY security_id, item, period_type, period_end ORDER BY filed_at, value) AS v0 FROM a)
    SELECT security_id, item, period_type, period_end, round_even(value, 6) AS value, filed_at FROM z WHERE v0 IS NULL OR v0 <> value""",
)
def st_quarterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.quarterise(_facts(spark, sf_dir)).withColumn("value", r6(F.col("value")))


@query(
    "st_revision",
    f"""WITH {_FACTS}, s AS (SELECT security_id, filed AS date, value FROM facts WHERE item = 'revenue' AND rank = 0 AND filed <= DATE '1998-06-30'),
    r AS (SELECT security_id, last(value ORDER BY date, value) AS now, last(value ORDER BY date, value) FILTER (date <= DATE '1998-06-30' - 90) AS before FROM s GROUP BY 1)
    SELECT security_id, CASE WHEN before IS NOT NULL THEN CASE WHEN now > before THEN 'up' WHEN now < before THEN 'down' ELSE 'flat' END END AS direction FROM r""",
)
def st_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = _facts(spark, sf_dir).where("item = 'revenue' and rank = 0").select("security_id", F.col("filed").alias("date"), "value")
    return fu.revision(snapshots, F.to_date(F.lit("1998-06-30")), 90)


_BOOK = {
    "eps": "CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size - 5 AS DOUBLE) / 3 END", "shares": "CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size * 10 AS DOUBLE) END", "equity": "CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 13 - 2 AS DOUBLE) * 100 END",
    "ebitda": "CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 17 - 3 AS DOUBLE) * 50 END", "debt": "CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 19 AS DOUBLE) * 10 END", "cash": "CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey % 23 AS DOUBLE) * 10 END",
    "fcf": "CASE WHEN p_partkey % 8 <> 0 THEN CAST(p_partkey % 29 - 9 AS DOUBLE) * 5 END", "dividend": "CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 3 AS DOUBLE) END",
}


@query(
    "val_multiples",
    f"""WITH b AS (SELECT p_partkey AS security_id, p_retailprice AS price, {', '.join(f'{e} AS {n}' for n, e in _BOOK.items())} FROM part), c AS (SELECT *, price * shares AS cap FROM b)
    SELECT security_id, round_even(CASE WHEN eps > 0 THEN price / eps END, 6) AS pe, CASE WHEN eps IS NULL THEN 'no eps' WHEN eps <= 0 THEN 'eps is not positive' END AS pe_reason,
      round_even(CASE WHEN equity > 0 THEN cap / equity END, 6) AS pb, CASE WHEN cap IS NULL THEN 'no share count' WHEN equity IS NULL THEN 'no equity' WHEN equity <= 0 THEN 'equity is not positive' END AS pb_reason,
      round_even(CASE WHEN ebitda > 0 THEN (cap + debt - cash) / ebitda END, 6) AS ev_ebitda, CASE WHEN cap IS NULL THEN 'no share count' WHEN debt IS NULL THEN 'no debt' WHEN cash IS NULL THEN 'no cash' WHEN ebitda IS NULL THEN 'no ebitda' WHEN ebitda <= 0 THEN 'ebitda is not positive' END AS ev_ebitda_reason,
      round_even(CASE WHEN cap > 0 THEN 100 * fcf / cap END, 6) AS fcf_yield_pct, CASE WHEN cap IS NULL THEN 'no share count' WHEN fcf IS NULL THEN 'no cash flow' END AS fcf_yield_pct_reason,
      round_even(100 * dividend / price, 6) AS dividend_yield_pct, CASE WHEN dividend IS NULL THEN 'no dividend' END AS dividend_yield_pct_reason FROM c""",
)
def val_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = table(spark, sf_dir, "part").selectExpr("p_partkey as security_id", "p_retailprice as price", *[f"{e} as {n}" for n, e in _BOOK.items()])
    found = fu.multiples(*[F.col(c) for c in ("price", "eps", "shares", "equity", "ebitda", "debt", "cash", "fcf", "dividend")])
    return book.select("security_id", *[x for n, (value, why) in found.items() for x in (r6(value).alias(n), why.alias(f"{n}_reason"))])


_FLAG_INPUTS = {
    "pledge": "CASE WHEN k % 6 <> 0 THEN CAST(k * 7 % 31 AS DOUBLE) END", "rising": "CASE WHEN k % 4 <> 0 THEN k % 5 = 0 END", "cfo": "CASE WHEN k % 8 <> 0 THEN CAST(k * 3 % 50 AS DOUBLE) END", "pat": "CAST(k * 11 % 60 - 5 AS DOUBLE)",
    "owed": "CASE WHEN k % 3 <> 0 THEN CAST(k % 40 AS DOUBLE) END", "worth": "CAST(k * 13 % 200 - 10 AS DOUBLE)", "filings": "k % 4", "changes": "CASE WHEN k % 4 > 2 THEN 1 ELSE 0 END",
}


@query(
    "red_flags_single",
    f"""WITH k AS (SELECT c_custkey AS k FROM customer), i AS (SELECT k AS security_id, {', '.join(f'{e} AS {n}' for n, e in _FLAG_INPUTS.items())} FROM k)
    SELECT security_id, CASE WHEN pledge IS NULL THEN 'not_evaluable' WHEN pledge > 20 OR coalesce(rising, false) THEN 'fired' WHEN rising IS NULL THEN 'not_evaluable' ELSE 'clear' END AS pledge,
      CASE WHEN cfo IS NULL OR pat <= 0 THEN 'not_evaluable' WHEN cfo / pat < 0.5 THEN 'fired' ELSE 'clear' END AS cfo_to_pat, CASE WHEN owed IS NULL OR worth <= 0 THEN 'not_evaluable' WHEN 100 * owed / worth > 20 THEN 'fired' ELSE 'clear' END AS contingent_liabilities,
      CASE WHEN filings = 0 THEN 'not_evaluable' WHEN changes > 0 THEN 'fired' ELSE 'clear' END AS auditor_change FROM i""",
)
def red_flags_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    inputs = table(spark, sf_dir, "customer").select(c("c_custkey").alias("k")).selectExpr("k as security_id", *[f"{e} as {n}" for n, e in _FLAG_INPUTS.items()])
    flags = {"pledge": fu.pledge_flag(c("pledge"), c("rising")), "cfo_to_pat": fu.cash_flag(c("cfo"), c("pat")), "contingent_liabilities": fu.contingent_flag(c("owed"), c("worth")), "auditor_change": fu.auditor_flag(c("filings"), c("changes"))}
    return inputs.select("security_id", *[flag.alias(n) for n, flag in flags.items()])


@query(
    "macro_last_change",
    f"""WITH {BARS}, s AS (SELECT security_id, date, floor(close / 250) AS v, lag(floor(close / 250)) OVER (PARTITION BY security_id ORDER BY date) AS b FROM bars)
    SELECT security_id, max_by(v, date)::DOUBLE AS last_value, max(date) FILTER (b <> v) AS changed_on FROM s GROUP BY 1""",
)
def macro_last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.last_change(bars(spark, sf_dir).select("security_id", "date", F.floor(F.col("close") / 250).cast("double").alias("v")), "security_id", "date", "v")


@query(
    "sch_due_jobs",
    f"""WITH {BARS}, j AS (SELECT security_id AS job, min(date) AS first, max(date) AS last FROM bars GROUP BY 1), d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)
    SELECT job, date FROM j JOIN d ON date BETWEEN first AND last ANTI JOIN (SELECT security_id AS job, date FROM bars) USING (job, date)""",
)
def sch_due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bars(spark, sf_dir).select(F.col("security_id").alias("job"), "date")
    jobs = done.groupBy("job").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return schedule.due(jobs, table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct(), done)


_REVIEWS = {
    "proposed": "CASE k % 5 WHEN 0 THEN 'ADD' WHEN 1 THEN 'HOLD' WHEN 2 THEN 'REVIEW' WHEN 3 THEN 'TRIM' ELSE 'EXIT' END", "value": "CASE WHEN k % 6 <> 0 THEN CAST(k % 10 AS DOUBLE) END", "comparator": "CASE k % 4 WHEN 0 THEN 'lt' WHEN 1 THEN 'lte' WHEN 2 THEN 'gt' ELSE 'gte' END",
    "threshold": "CAST(k % 7 AS DOUBLE)", "machine": "k % 9 <> 0", "said": "CASE k % 3 WHEN 0 THEN 'met' WHEN 1 THEN 'not_met' ELSE 'unknown' END", "soft": "k % 11 = 0", "reason": "CASE WHEN k % 8 = 0 THEN ' patience ' WHEN k % 8 = 1 THEN ' ' END",
}


@query(
    "rv_action_floor",
    f"""WITH k AS (SELECT o_orderkey AS k FROM orders), i AS (SELECT k, {', '.join(f'{e} AS {n}' for n, e in _REVIEWS.items())} FROM k),
    c AS (SELECT *, CASE WHEN value IS NULL THEN 'unknown' WHEN CASE comparator WHEN 'lt' THEN value < threshold WHEN 'lte' THEN value <= threshold WHEN 'gt' THEN value > threshold ELSE value >= threshold END THEN 'met' ELSE 'not_met' END AS computed FROM i),
    m AS (SELECT *, CASE WHEN NOT machine THEN said WHEN computed <> 'unknown' THEN computed WHEN said = 'not_met' THEN 'unknown' ELSE said END AS status FROM c),
    p AS (SELECT *, CASE WHEN status = 'met' AND coalesce(trim(reason) <> '', false) THEN 3 WHEN status = 'met' THEN 4 WHEN soft THEN 3 ELSE 1 END AS cap FROM m)
    SELECT k AS review_id, status, ['ADD', 'HOLD', 'REVIEW', 'TRIM', 'EXIT'][greatest(cap, list_position(['ADD', 'HOLD', 'REVIEW', 'TRIM', 'EXIT'], proposed))] AS action FROM p""",
)
def rv_action_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    cases = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k")).selectExpr("k", *[f"{e} as {n}" for n, e in _REVIEWS.items()])
    judged = cases.withColumn("status", review.merged_status(c("machine"), review.criterion_status(c("value"), c("comparator"), c("threshold")), c("said")))
    return judged.select(c("k").alias("review_id"), "status", review.action_floor(c("proposed"), c("status") == "met", c("soft"), c("reason")).alias("action"))


_LOTS = """lots AS (SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice AS price, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / l_quantity END AS cost, l_quantity AS quantity, date_diff('day', l_shipdate::DATE, DATE '2000-01-01') AS days
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate < TIMESTAMP '2000-01-01')"""


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("price"))
    cost = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / F.col("l_quantity"))
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return lines.join(prices, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "price", cost.alias("cost"), F.col("l_quantity").alias("quantity"), F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("l_shipdate")).alias("days"))


@query(
    "tx_lot_line",
    f"""WITH {_LOTS}, g AS (SELECT *, (price - cost) * quantity AS gain, days >= 365 AS long_term FROM lots), t AS (SELECT *, greatest(gain, 0) * CASE WHEN long_term THEN 12.5::DOUBLE ELSE 20.0::DOUBLE END / 100 AS tax_now, greatest(gain, 0) * 12.5::DOUBLE / 100 AS tax_long FROM g)
    SELECT l_orderkey, l_linenumber, long_term, greatest(365 - days, 0)::INT AS days_to_long, round_even(gain, 6) AS gain, round_even(CASE WHEN gain IS NOT NULL THEN tax_now END, 6) AS tax_now, round_even(CASE WHEN gain IS NOT NULL THEN tax_long END, 6) AS tax_long FROM t""",
)
def tx_lot_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.lot_tax(*[F.col(c) for c in ("price", "cost", "quantity", "days")], 365, 20.0, 12.5)
    known = found["gain"].isNotNull()
    return _lots(spark, sf_dir).select("l_orderkey", "l_linenumber", found["long_term"].alias("long_term"), found["days_to_long"].alias("days_to_long"), r6(found["gain"]).alias("gain"), *[r6(F.when(known, found[c])).alias(c) for c in ("tax_now", "tax_long")])


@query("mf_exit_load", f"WITH {_LOTS} SELECT l_partkey AS fund, count(*) FILTER (days < 365) AS inside, round_even(sum(CASE WHEN days < 365 THEN price * quantity * 1.0::DOUBLE / 100 ELSE 0 END), 6) AS load FROM lots GROUP BY 1")
def mf_exit_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = review.exit_load(F.col("price") * F.col("quantity"), F.col("days"), 1.0, 365)
    return _lots(spark, sf_dir).groupBy(F.col("l_partkey").alias("fund")).agg(F.count(F.when(F.col("days") < 365, 1)).alias("inside"), r6(F.sum(load)).alias("load"))


@query(
    "dm_stats",
    """SELECT c_mktsegment AS cohort, round_even(avg(c_acctbal), 6) AS mean, round_even(median(c_acctbal), 6) AS median, round_even(stddev_samp(c_acctbal), 6) AS sd, round_even(stddev_pop(c_acctbal), 6) AS sd_pop,
    round_even(covar_samp(c_acctbal, c_custkey), 4) AS covariance, round_even(100.0::DOUBLE * count(*) FILTER (c_acctbal > 0) / count(*), 2) AS coverage_pct FROM customer GROUP BY 1""",
)
def dm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance, key = F.col("c_acctbal"), F.col("c_custkey").cast("double")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("cohort")).agg(
        r6(F.avg(balance)).alias("mean"), r6(F.median(balance)).alias("median"), r6(F.stddev_samp(balance)).alias("sd"), r6(F.stddev_pop(balance)).alias("sd_pop"),
        F.bround(F.covar_samp(balance, key), 4).alias("covariance"), F.bround(100 * F.avg((balance > 0).cast("double")), 2).alias("coverage_pct"),
    )


@query("sec_lookup")
def sec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier asked for by key, by name in capitals, by a name cut short within a word, and by symbol: four queries each."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"), F.lit(None).cast("string").alias("isin"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.concat_ws(" ", F.lit("Supply"), F.translate("s_name", "#", " "), F.lit("Ltd")).alias("name"))
    cut_short = F.substring(F.col("name"), F.lit(1), F.length("name") - len("00 Ltd"))
    forms = F.array(F.concat(F.lit("id:"), F.col("security_id").cast("string")), F.upper("name"), F.lower(cut_short), F.lower("symbol"))
    asked = rows.select("security_id", F.posexplode(forms).alias("form", "text"))
    found = names.lookup(asked.select((F.col("security_id") * 4 + F.col("form")).alias("query_id"), "text"), rows)
    return found.select("query_id", "text", "how", "security_id", F.size("candidates").alias("n_candidates"))


_PROFITS = {"income": "CASE WHEN k % 10 <> 0 THEN CAST(k * 7 % 53 + 90 AS DOUBLE) END", "minority": "CASE WHEN k % 4 = 0 THEN CAST(k % 6 AS DOUBLE) END", "eps": "CASE WHEN k % 9 <> 0 THEN CAST(k % 5 AS DOUBLE) END", "shares": "CASE WHEN k % 11 <> 0 THEN CAST(k * 3 % 47 + 20 AS DOUBLE) END"}


@query(
    "fa_attributable",
    f"""WITH k AS (SELECT c_custkey AS k FROM customer), i AS (SELECT k AS security_id, {', '.join(f'{e} AS {n}' for n, e in _PROFITS.items())} FROM k), g AS (SELECT *, eps * shares AS parent, round_even((income - eps * shares) / nullif(eps * shares, 0) * 100, 2) AS gap FROM i),
    b AS (SELECT *, CASE WHEN income IS NULL THEN 'unknown' WHEN minority IS NOT NULL THEN 'reported_minority' WHEN parent IS NULL OR parent <= 0 THEN 'unknown' WHEN abs(gap) <= 3 THEN 'no_minority' WHEN gap > 0 THEN 'eps_x_shares' ELSE 'unknown' END AS basis FROM g)
    SELECT security_id, round_even(CASE basis WHEN 'reported_minority' THEN income - minority WHEN 'eps_x_shares' THEN parent ELSE income END, 6) AS profit, basis FROM b""",
)
def fa_attributable(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).selectExpr("k as security_id", *[f"{e} as {n}" for n, e in _PROFITS.items()])
    profit, basis = fu.attributable_profit(*[F.col(c) for c in ("income", "minority", "eps", "shares")])
    return figures.select("security_id", r6(profit).alias("profit"), basis.alias("basis"))
