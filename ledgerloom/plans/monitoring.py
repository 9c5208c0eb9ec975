"""Queries over what is watched and stored: zones, regime, runs, drawdowns, rates as of a day, newest ingests, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import mid_rank, r6, ratio
from ledgerloom.operators import indicators as ta
from ledgerloom.operators import monitor, pit
from ledgerloom.plans.bindings import BARS, bars, benchmark
from ledgerloom.plans.registry import query, table

W = "OVER (PARTITION BY security_id ORDER BY date"
_SMA = f"s AS (SELECT *, CASE WHEN count(*) {W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 50 THEN avg(close) {W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS sma, row_number() {W}) AS pos, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM bars)"


@query(
    "rv_sessions_below_sma",
    f"""WITH {BARS}, {_SMA} SELECT security_id, CASE WHEN max(pos) >= 50 THEN max(pos) - coalesce(max(pos) FILTER (sma IS NULL OR close >= sma), 0) END AS below FROM s GROUP BY 1""",
)
def rv_sessions_below_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.sessions_below_average(bars(spark, sf_dir), 50)


@query(
    "sc_max_drawdown_closes",
    f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM bars), p AS (SELECT *, max(close) {W} ROWS UNBOUNDED PRECEDING) AS peak FROM r WHERE k <= 252)
    SELECT security_id, CASE WHEN count(*) >= 60 THEN round_even(max((peak - close) / peak * 100), 4) END AS max_drawdown_pct FROM p GROUP BY 1""",
)
def sc_max_drawdown_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.max_drawdown(bars(spark, sf_dir), 252, 60)


@query(
    "rg_regime",
    f"""WITH {BARS}, {_SMA}, t AS (SELECT count(*) AS names, sum((close > sma)::INT)::BIGINT AS above FROM s WHERE k = 1 AND sma IS NOT NULL), b AS (SELECT names, CASE WHEN names > 0 THEN 100.0::DOUBLE * above / names END AS breadth FROM t)
    , i AS (SELECT CASE WHEN count(*) = 50 THEN max_by(benchmark, date) > avg(benchmark) END AS index_above FROM (SELECT * FROM bench ORDER BY date DESC LIMIT 50))
    SELECT names, round_even(breadth, 6) AS breadth_pct, index_above, CASE WHEN index_above IS NULL OR names < 20 THEN 'unavailable' WHEN index_above AND breadth >= 60 THEN 'risk_on' WHEN NOT index_above AND breadth <= 40 THEN 'risk_off' ELSE 'neutral' END AS regime FROM b, i""",
)
def rg_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.regime(bars(spark, sf_dir), benchmark(spark, sf_dir).withColumnRenamed("benchmark", "close"), 50, 60.0, 40.0, 20)


_ZONE = f"z AS (SELECT security_id, date, close, lag(close) {W}) AS before, min(low) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS low10, avg(close) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS high10 FROM bars)"


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    ten = ta.by_date().rowsBetween(-10, -1)
    return bars(spark, sf_dir).withColumns({"before": F.lag("close").over(ta.by_date()), "low10": F.min("low").over(ten), "high10": F.avg("close").over(ten)})


@query(
    "wd_watch_distance",
    f"""WITH {BARS}, {_ZONE} SELECT security_id, date, CASE WHEN low10 IS NULL THEN 'unknown' WHEN close > high10 THEN 'above' WHEN close < low10 THEN 'below' ELSE 'inside' END AS side,
    round_even(CASE WHEN close > high10 THEN (close - high10) / high10 * 100 WHEN close < low10 THEN (close - low10) / low10 * 100 WHEN low10 IS NOT NULL THEN 0.0::DOUBLE END, 6) AS pct FROM z""",
)
def wd_watch_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    side, pct = monitor.watch_distance(F.col("close"), F.col("low10"), F.col("high10"))
    return _zones(spark, sf_dir).select("security_id", "date", side.alias("side"), r6(pct).alias("pct"))


@query("al_entered_zone", f"WITH {BARS}, {_ZONE} SELECT security_id, date FROM z WHERE close BETWEEN low10 AND high10 AND before IS NOT NULL AND NOT before BETWEEN low10 AND high10")
def al_entered_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zones(spark, sf_dir).where(monitor.entered_zone(F.col("close"), F.col("before"), F.col("low10"), F.col("high10"))).select("security_id", "date")


@query("al_below_invalidation", f"WITH {BARS}, {_ZONE} SELECT security_id, date, close, low10 AS level FROM z WHERE close < low10")
def al_below_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zones(spark, sf_dir).where("close < low10").select("security_id", "date", "close", F.col("low10").alias("level"))


@query(
    "universe_rs_percentile",
    f"""WITH {BARS}, r AS (SELECT security_id, date, b.close / benchmark AS ratio FROM bars b JOIN bench USING (date)), c AS (SELECT security_id, date, ratio / lag(ratio, 126) {W}) - 1 AS change, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM r),
    l AS (SELECT * FROM c WHERE k = 1) SELECT security_id, round_even(100 * change, 6) AS change_pct,
    round_even(CASE WHEN change IS NOT NULL THEN 100.0::DOUBLE * (count(change) OVER (ORDER BY change) - 0.5::DOUBLE * count(change) OVER (PARTITION BY change)) / count(change) OVER () END, 6) AS rs_percentile FROM l""",
)
def universe_rs_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = bars(spark, sf_dir).join(benchmark(spark, sf_dir), "date").withColumn("ratio", F.col("close") / F.col("benchmark"))
    changed = joined.withColumns({"change": ratio(F.col("ratio"), F.lag("ratio", 126).over(ta.by_date())) - 1, "k": F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("date")))}).where("k = 1")
    return changed.select("security_id", r6(100 * F.col("change")).alias("change_pct"), r6(mid_rank(F.col("change"))).alias("rs_percentile"))


@query(
    "dm_correlation",
    f"""WITH {BARS}, r AS (SELECT security_id, date, b.close / lag(b.close) {W}) - 1 AS a, benchmark / lag(benchmark) {W}) - 1 AS m FROM bars b JOIN bench USING (date))
    SELECT security_id, count(*) AS n, round_even(covar_samp(a, m), 6) AS covariance, round_even(corr(a, m), 6) AS correlation FROM r WHERE a IS NOT NULL GROUP BY 1""",
)
def dm_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = bars(spark, sf_dir).join(benchmark(spark, sf_dir), "date").withColumns({"a": ta.daily_return(), "m": ratio(F.col("benchmark"), F.lag("benchmark").over(ta.by_date())) - 1}).where("a is not null")
    return joined.groupBy("security_id").agg(F.count("*").alias("n"), r6(F.covar_samp("a", "m")).alias("covariance"), r6(F.corr("a", "m")).alias("correlation"))


@query(
    "best_source_nav",
    """WITH n AS (SELECT user_id, CAST(ts AS DATE) AS date, event_type AS source, max(value) AS nav FROM events GROUP BY ALL)
    SELECT user_id, date, source, nav FROM n QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY CASE source WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, source) = 1""",
)
def best_source_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    navs = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date"), F.col("event_type").alias("source")).agg(F.max("value").alias("nav"))
    return pit.best_source(navs, ["user_id", "date"], "source", ["purchase", "view"])


@query(
    "fx_asof",
    """WITH rates AS (SELECT l_linestatus AS currency, CAST(l_shipdate AS DATE) AS rate_date, max(l_extendedprice) AS rate FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1, 2),
    asked AS (SELECT o_orderkey, o_orderstatus AS currency, CAST(o_orderdate AS DATE) AS on_date FROM orders),
    j AS (SELECT a.*, r.rate_date, r.rate FROM asked a ASOF LEFT JOIN rates r ON a.currency = r.currency AND a.on_date >= r.rate_date)
    SELECT o_orderkey, CASE WHEN on_date - rate_date <= 30 THEN rate END AS rate, CASE WHEN on_date - rate_date <= 30 THEN on_date - rate_date > 10 ELSE false END AS stale,
    CASE WHEN rate_date IS NULL THEN 'none on or before' WHEN on_date - rate_date > 30 THEN 'too old' END AS reason FROM j""",
)
def fx_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last positive rate on or before a day: refused when over 30 days old, stale when over 10."""
    rates = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0").groupBy(F.col("l_linestatus").alias("currency"), F.to_date("l_shipdate").alias("rate_date")).agg(F.max("l_extendedprice").alias("rate"))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("currency"), F.to_date("o_orderdate").alias("on_date"))
    found = pit.asof_join(asked, rates, ["currency"], "on_date", "rate_date", ["rate"])
    age = F.datediff("on_date", "asof_rate_date")
    usable = F.coalesce(age <= 30, F.lit(False))
    return found.select("o_orderkey", F.when(usable, F.col("asof_rate")).alias("rate"), (usable & F.coalesce(age > 10, F.lit(False))).alias("stale"), F.when(age.isNull(), "none on or before").when(age > 30, "too old").alias("reason"))


@query("latest_ingest_view", "SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY CAST(o_orderdate AS DATE) = max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey, o_orderpriority)")
def latest_ingest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("as_of"))
    return monitor.newest_ingest(held, ["o_custkey", "o_orderpriority"], "as_of").drop("as_of")


_DECISIONS = "d AS (SELECT event_id AS id, user_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN lag(event_id) OVER w END AS corrects_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


@query("effective_decisions", f"WITH {_DECISIONS} SELECT id, user_id, event_type FROM d WHERE id NOT IN (SELECT corrects_id FROM d WHERE corrects_id IS NOT NULL)")
def effective_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("event_id")
    corrects = F.when(F.lag("event_type").over(own) == F.col("event_type"), F.lag("event_id").over(own))
    decisions = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", corrects.alias("corrects_id"))
    return pit.effective_rows(decisions).select("id", "user_id", "event_type")


@query("sink_ingest_occurrence", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) - 1 AS occurrence FROM lineitem")
def sink_ingest_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.occurrence(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).withColumn("occurrence", F.col("occurrence").cast("long"))


@query("index_constituent_union", "SELECT p_brand AS security_id, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS member_of FROM part GROUP BY 1")
def index_constituent_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("security_id")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("member_of"))


@query("peers", "SELECT a.n_nationkey AS security_id, b.n_nationkey AS peer_id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of the same industry; the dimension has one row per company."""
    one = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("security_id"), "n_regionkey")
    return one.join(one.withColumnRenamed("security_id", "peer_id"), "n_regionkey").where("security_id <> peer_id").select("security_id", "peer_id")


@query("filing_items", "SELECT o_orderkey, o_orderstatus, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def filing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(sections, "o_orderkey").groupBy("o_orderkey", "o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("items"))
