"""Queries over bars: indicators, levels, alerts, quality, adjustment, point-in-time reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import mid_rank, r6, ratio
from ledgerloom.operators import indicators as ta
from ledgerloom.operators import pit, prices
from ledgerloom.plans.bindings import BARS, STATEMENTS, bars, benchmark, statements
from ledgerloom.plans.registry import query, table

W = "OVER (PARTITION BY security_id ORDER BY date"


def _last(df: DataFrame) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("date")))
    return df.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


@query(
    "scr_relative_strength",
    f"""WITH {BARS}, r AS (SELECT security_id, date, b.close, b.close / benchmark AS ratio, count(*) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n,
      avg(b.close) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sma FROM bars b JOIN bench USING (date)),
    c AS (SELECT *, ratio / lag(ratio, 20) {W}) - 1 AS change, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM r),
    l AS (SELECT * FROM c WHERE k = 1 AND n = 20),
    p AS (SELECT security_id, date, 100 * (close / sma - 1) AS price_vs_sma, CASE WHEN change IS NOT NULL THEN
      100.0::DOUBLE * (count(change) OVER (ORDER BY change) - 0.5::DOUBLE * count(change) OVER (PARTITION BY change)) / count(change) OVER () END AS rs_percentile FROM l)
    SELECT security_id, date, round_even(price_vs_sma, 6) AS price_vs_sma, round_even(rs_percentile, 6) AS rs_percentile FROM p
    WHERE price_vs_sma > 0 AND rs_percentile >= 50""",
)
def scr_relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = bars(spark, sf_dir).join(benchmark(spark, sf_dir), "date").withColumn("ratio", F.col("close") / F.col("benchmark"))
    seen = _last(joined.withColumns({"sma": ta.sma(20), "change": ratio(F.col("ratio"), F.lag("ratio", 20).over(ta.by_date())) - 1})).where("sma is not null")
    ranked = seen.select("security_id", "date", (100 * (F.col("close") / F.col("sma") - 1)).alias("price_vs_sma"), mid_rank(F.col("change")).alias("rs_percentile"))
    return ranked.where("price_vs_sma > 0 and rs_percentile >= 50").select("security_id", "date", r6(F.col("price_vs_sma")).alias("price_vs_sma"), r6(F.col("rs_percentile")).alias("rs_percentile"))


_CELLS = f"""WITH {BARS}, m AS (SELECT *, close / lag(close) {W}) - 1 AS ret, close - lag(close) {W}) AS move, lag(close) {W}) AS pc FROM bars),
  c AS (SELECT security_id, date, count(*) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n20, count(*) {W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS n50,
    count(ret) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS nr, close,
    avg(close) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sma20, avg(close) {W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sma50,
    close / lag(close, 63) {W}) - 1 AS roc63, stddev_pop(close) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd,
    stddev_samp(ret) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol, max(high) {W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS top,
    min(low) {W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS bottom, avg(volume) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS av,
    sum(CASE WHEN move > 0 THEN volume ELSE 0 END) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS up, sum(CASE WHEN move < 0 THEN volume ELSE 0 END) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS down,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr0, pc, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM m)"""


@query(
    "ta_compute_windows",
    _CELLS
    + """ SELECT security_id, date, round_even(CASE WHEN n20 = 20 THEN sma20 END, 6) AS sma20, round_even(CASE WHEN n50 = 50 THEN sma50 END, 6) AS sma50, round_even(roc63, 6) AS roc63,
    round_even(CASE WHEN n20 = 20 THEN 4.0 * sd / sma20 END, 6) AS boll_width, round_even(CASE WHEN nr = 20 THEN vol * sqrt(252.0) END, 6) AS realised_vol,
    round_even(CASE WHEN n50 = 50 THEN 100 * (close - top) / top END, 6) AS from_high, round_even(CASE WHEN n50 = 50 THEN 100 * (close - bottom) / bottom END, 6) AS from_low,
    round_even(CASE WHEN n20 = 20 THEN av END, 6) AS avg_volume, round_even(up / nullif(down, 0), 6) AS updown_volume, round_even(CASE WHEN pc IS NOT NULL THEN tr0 END, 6) AS true_range FROM c WHERE k = 1""",
)
def ta_compute_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed cells of the last bar of each security."""
    up, down = ta.updown_volume(20)
    high, low = ta.high_low_distance(50)
    first = bars(spark, sf_dir).withColumns({"ret": ta.daily_return(), "up": up, "down": down, "true_range": ta.true_range()})
    cells = {
        "sma20": ta.sma(20), "sma50": ta.sma(50), "roc63": ta.roc(63), "boll_width": ta.bollinger_width(20, 2.0), "realised_vol": ta.realised_vol("ret", 20), "from_high": high, "from_low": low,
        "avg_volume": ta.sma(20, "volume"), "updown_volume": ratio(F.sum("up").over(ta.rows(20)), F.sum("down").over(ta.rows(20))), "true_range": F.col("true_range"),
    }
    return _last(first.withColumns(cells)).select("security_id", "date", *[r6(F.col(c)).alias(c) for c in cells])


@query(
    "ta_ema_rsi_macd",
    f"""WITH {BARS}, s AS (SELECT security_id, list(close ORDER BY date) AS c FROM bars GROUP BY 1),
    d AS (SELECT security_id, c, list_transform(range(2, len(c) + 1), lambda i: c[i] - c[i - 1]) AS m FROM s),
    e AS (SELECT *, list_transform(m, lambda x: greatest(x, 0.0)) AS u, list_transform(m, lambda x: greatest(-x, 0.0)) AS v FROM d),
    f AS (SELECT *, list_reduce(list_prepend(list_sum(u[1:14]) / 14, u[15:]), lambda a, x: (a * 13 + x) / 14) AS up,
      list_reduce(list_prepend(list_sum(v[1:14]) / 14, v[15:]), lambda a, x: (a * 13 + x) / 14) AS down FROM e)
    SELECT security_id, round_even(CASE WHEN len(c) >= 21 THEN list_reduce(list_prepend(list_sum(c[1:21]) / 21, c[22:]), lambda a, x: a + (2.0::DOUBLE / 22) * (x - a)) END, 6) AS ema21,
      round_even(CASE WHEN len(m) >= 14 AND up + down > 0 THEN 100.0 * up / (up + down) END, 6) AS rsi14,
      round_even(CASE WHEN len(c) >= 34 THEN list_reduce(list_prepend(list_sum(c[1:12]) / 12, c[13:]), lambda a, x: a + (2.0::DOUBLE / 13) * (x - a))
        - list_reduce(list_prepend(list_sum(c[1:26]) / 26, c[27:]), lambda a, x: a + (2.0::DOUBLE / 27) * (x - a)) END, 6) AS macd_line FROM f""",
)
def ta_ema_rsi_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ta.series(bars(spark, sf_dir), "close").select("security_id", r6(ta.ema(F.col("close"), 21)).alias("ema21"), r6(ta.rsi(F.col("close"), 14)).alias("rsi14"), r6(ta.macd(F.col("close"))["line"]).alias("macd_line"))


@query(
    "ta_atr",
    f"""WITH {BARS}, t AS (SELECT security_id, date, lag(close) {W}) AS pc, high, low FROM bars),
    s AS (SELECT security_id, list(greatest(high - low, abs(high - pc), abs(low - pc)) ORDER BY date) AS r FROM t WHERE pc IS NOT NULL GROUP BY 1)
    SELECT security_id, round_even(CASE WHEN len(r) >= 14 THEN list_reduce(list_prepend(list_sum(r[1:14]) / 14, r[15:]), lambda a, x: (a * 13 + x) / 14) END, 6) AS atr14 FROM s""",
)
def ta_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = bars(spark, sf_dir).withColumn("tr", ta.true_range()).where("tr is not null")
    return ta.series(ranged, "tr").select("security_id", r6(ta.wilder(F.col("tr"), 14)).alias("atr14"))


@query(
    "ta_weekly_trend",
    f"""WITH {BARS}, w AS (SELECT security_id, CAST(date_trunc('week', date) AS DATE) AS week, max(date) AS date, max_by(close, date) AS close FROM bars GROUP BY 1, 2),
    s AS (SELECT *, avg(close) {W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a, avg(close) {W} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS b,
      count(*) {W} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS n, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM w)
    SELECT security_id, week, CASE WHEN n = 40 THEN CASE WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'flat' END END AS trend FROM s WHERE k = 1""",
)
def ta_weekly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = ta.weekly_closes(bars(spark, sf_dir)).withColumns({"a": ta.sma(10), "b": ta.sma(40)})
    trend = F.when(F.col("a") > F.col("b"), "up").when(F.col("a") < F.col("b"), "down").when(F.col("b").isNotNull(), "flat")
    return _last(weekly).select("security_id", "week", trend.alias("trend"))


@query(
    "lv_swing_pivots",
    f"""WITH {BARS}, s AS (SELECT security_id, date, high, low, count(*) {W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n, max(high) {W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS h,
      max(high) {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hb, min(low) {W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS l, min(low) {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lb FROM bars)
    SELECT security_id, date, round_even(high, 8) AS high, round_even(low, 8) AS low, (h = high AND hb < high) AS is_high, (l = low AND lb > low) AS is_low
    FROM s WHERE n = 11 AND ((h = high AND hb < high) OR (l = low AND lb > low))""",
)
def lv_swing_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = ta.swing_pivots(5)
    return bars(spark, sf_dir).withColumns({"is_high": high, "is_low": low}).where("is_high or is_low").select("security_id", "date", F.bround("high", 8).alias("high"), F.bround("low", 8).alias("low"), "is_high", "is_low")


@query(
    "lv_gap_zones",
    f"""WITH {BARS}, s AS (SELECT security_id, date, high, low, lag(high) {W}) AS hb, lag(low) {W}) AS lb, min(low) {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ll,
      max(high) {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lh FROM bars),
    z AS (SELECT *, CASE WHEN (low - hb) / hb * 100 >= 1.0 AND coalesce(ll > hb, true) THEN 'up' WHEN (lb - high) / lb * 100 >= 1.0 AND coalesce(lh < lb, true) THEN 'down' END AS side FROM s)
    SELECT security_id, date, side, round_even(CASE WHEN side = 'up' THEN hb ELSE high END, 6) AS low_edge, round_even(CASE WHEN side = 'up' THEN low ELSE lb END, 6) AS high_edge FROM z WHERE side IS NOT NULL""",
)
def lv_gap_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ta.gap_zones(bars(spark, sf_dir), 1.0).select("security_id", "date", "side", r6(F.col("low_edge")).alias("low_edge"), r6(F.col("high_edge")).alias("high_edge"))


@query(
    "rg_breadth",
    f"""WITH {BARS}, s AS (SELECT security_id, close, avg(close) {W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS a, count(*) {W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS n,
      row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM bars), b AS (SELECT 100.0::DOUBLE * avg(CAST(close > a AS INT)) AS breadth, count(*) AS names FROM s WHERE k = 1 AND n = 50)
    SELECT names, round_even(breadth, 6) AS breadth_pct, CASE WHEN names < 20 THEN 'too few names' WHEN breadth >= 60 THEN 'risk_on' WHEN breadth <= 40 THEN 'risk_off' ELSE 'neutral' END AS regime FROM b""",
)
def rg_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _last(bars(spark, sf_dir).withColumn("a", ta.sma(50))).where("a is not null")
    share = last.agg(F.count("*").alias("names"), (100 * F.avg((F.col("close") > F.col("a")).cast("int"))).alias("b"))
    regime = F.when(F.col("names") < 20, "too few names").when(F.col("b") >= 60, "risk_on").when(F.col("b") <= 40, "risk_off").otherwise("neutral")
    return share.select("names", r6(F.col("b")).alias("breadth_pct"), regime.alias("regime"))


@query(
    "al_big_move",
    f"""WITH {BARS}, m AS (SELECT security_id, date, close / lag(close) {W}) - 1 AS move FROM bars),
    s AS (SELECT *, stddev_samp(move) {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sd, count(move) {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n FROM m)
    SELECT security_id, date, round_even(move, 6) AS move, round_even(sd, 6) AS sd FROM s WHERE n = 20 AND sd > 0 AND abs(move) > 2.0 * sd""",
)
def al_big_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ta.big_moves(bars(spark, sf_dir)).select("security_id", "date", r6(F.col("move")).alias("move"), r6(F.col("sd")).alias("sd"))


@query(
    "al_break_range",
    f"""WITH {BARS}, s AS (SELECT security_id, date, close, volume, max(high) {W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS t, min(low) {W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS b,
      count(*) {W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS n, avg(volume) {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS u FROM bars)
    SELECT security_id, date, CASE WHEN close > t THEN 'high' ELSE 'low' END AS side, round_even(close, 6) AS close, volume FROM s WHERE n = 60 AND (close > t OR close < b) AND volume > 0.5 * u""",
)
def al_break_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ta.breaks(bars(spark, sf_dir), 60, 0.5, 20).select("security_id", "date", "side", r6(F.col("close")).alias("close"), "volume")


@query(
    "q_ohlc",
    f"""WITH {BARS} SELECT coalesce(CASE WHEN open < 0 THEN 'open negative' WHEN high < low THEN 'high below low' WHEN open < low OR open > high THEN 'open outside range'
      WHEN close < low OR close > high THEN 'close outside range' END, 'ok') AS fault, count(*) AS n FROM bars GROUP BY 1""",
)
def q_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy(F.coalesce(prices.bar_fault(), F.lit("ok")).alias("fault")).agg(F.count("*").alias("n"))


@query(
    "q_gap_weekdays",
    f"""WITH {BARS}, n AS (SELECT security_id, date, lead(date) {W}) AS nxt FROM bars),
    g AS (SELECT security_id, list_filter(CAST(generate_series(date + INTERVAL 1 DAY, nxt - INTERVAL 1 DAY, INTERVAL 1 DAY) AS DATE[]), lambda d: isodow(d) <= 5) AS days FROM n WHERE nxt - date > 1)
    SELECT security_id, list_min(days) AS gap_from, list_max(days) AS gap_to, len(days)::INT AS days FROM g WHERE len(days) > 3""",
)
def q_gap_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.missing_weekdays(bars(spark, sf_dir).select("security_id", "date"), 3)


_SPLITS = "splits AS (SELECT security_id, min(date) AS ex_date, 0.5::DOUBLE AS factor FROM bars GROUP BY security_id, year(date))"


@query(
    "adj_closes",
    f"""WITH {BARS}, {_SPLITS}, f AS (SELECT b.security_id, b.date, b.close, count(s.ex_date) AS n FROM bars b LEFT JOIN splits s ON s.security_id = b.security_id AND s.ex_date > b.date GROUP BY 1, 2, 3)
    SELECT security_id, date, round_even(close, 8) AS close, pow(0.5::DOUBLE, n) AS multiplier, floor(close * pow(0.5::DOUBLE, n) * 1000) / 1000 AS adj_close FROM f""",
)
def adj_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bars(spark, sf_dir)
    actions = own.groupBy("security_id", F.year("date").alias("y")).agg(F.min("date").alias("ex_date")).select("security_id", "ex_date", F.lit("split").alias("kind"), F.lit(2.0).alias("value"), F.lit(1).alias("source_rank"))
    adjusted = prices.adjusted_closes(own, prices.price_factors(actions, own))
    # cut, not rounded: halves of exact prices are ties, which the two engines round differently
    return adjusted.select("security_id", "date", F.bround("close", 8).alias("close"), "multiplier", (F.floor(F.col("close") * F.col("multiplier") * 1000) / 1000).alias("adj_close"))


@query(
    "q_cross_source",
    """WITH s AS (SELECT l_partkey AS security_id, CAST(l_shipdate AS DATE) AS date, l_returnflag AS source, max(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2, 3)
    SELECT a.security_id, a.date, round_even(a.close, 8) AS close, round_even(b.close, 8) AS other, CASE WHEN b.close IS NULL THEN 'single_source' WHEN abs(a.close - b.close) <= 0.05::DOUBLE * abs(b.close) THEN 'ok' ELSE 'mismatch' END AS state
    FROM s a LEFT JOIN s b ON a.security_id = b.security_id AND a.date = b.date AND b.source = 'N' WHERE a.source = 'A'""",
)
def q_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = sourced(spark, sf_dir)
    found = prices.cross_source(closes.where("source = 'A'"), closes.where("source = 'N'"), 0.05)
    return found.select("security_id", "date", F.bround("close", 8).alias("close"), F.bround("other", 8).alias("other"), "state")


def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes of parts with the return flag as their source."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("security_id"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("source")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


@query(
    "best_source_bar",
    """WITH s AS (SELECT l_partkey AS security_id, CAST(l_shipdate AS DATE) AS date, l_returnflag AS source, max(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2, 3)
    SELECT security_id, date, source, round_even(close, 8) AS close FROM s QUALIFY row_number() OVER (PARTITION BY security_id, date ORDER BY CASE source WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, source) = 1""",
)
def best_source_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.best_source(sourced(spark, sf_dir), ["security_id", "date"], "source", ["R", "A"]).select("security_id", "date", "source", F.bround("close", 8).alias("close"))


AS_OF = "1998-06-30"


@query(
    "pit_statement_source",
    f"""WITH {STATEMENTS} SELECT security_id, period_end, item, source, round_even(value, 2) AS value, filed_at FROM statements WHERE filed_at <= DATE '{AS_OF}'
    QUALIFY dense_rank() OVER (PARTITION BY security_id, period_end, item ORDER BY CASE source WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, source) = 1""",
)
def pit_statement_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pit.statement_source(statements(spark, sf_dir), ["security_id", "period_end", "item"], "source", ["2-HIGH", "1-URGENT"], F.lit(AS_OF).cast("date"))
    return own.select("security_id", "period_end", "item", "source", F.bround("value", 2).alias("value"), "filed_at")


@query(
    "pit_latest_as_of",
    f"""WITH {STATEMENTS} SELECT security_id, period_end, item, source, round_even(value, 2) AS value, filed_at FROM statements WHERE filed_at <= DATE '{AS_OF}'
    QUALIFY row_number() OVER (PARTITION BY security_id, period_end, item ORDER BY filed_at DESC, source) = 1""",
)
def pit_latest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pit.latest_as_of(statements(spark, sf_dir), ["security_id", "period_end", "item"], F.lit(AS_OF).cast("date"), ties=["source"])
    return own.select("security_id", "period_end", "item", "source", F.bround("value", 2).alias("value"), "filed_at")


@query(
    "series_asof",
    f"""WITH {BARS}, o AS (SELECT o_orderkey, p_brand AS security_id, CAST(max(o_orderdate) AS DATE) AS day FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
    SELECT o_orderkey, o.security_id, day, b.date AS asof_date, round_even(b.close, 8) AS asof_close FROM o ASOF LEFT JOIN bars b ON o.security_id = b.security_id AND o.day >= b.date""",
)
def series_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("security_id")), "l_partkey")
    asked = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "o_orderkey").groupBy("o_orderkey", "security_id").agg(F.max("day").alias("day"))
    return pit.asof_join(asked, bars(spark, sf_dir), ["security_id"], "day", "date", ["close"]).select("o_orderkey", "security_id", "day", "asof_date", F.bround("asof_close", 8).alias("asof_close"))


@query(
    "month_end_closes",
    f"WITH {BARS} SELECT security_id, CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS date, round_even(max_by(close, date), 8) AS close FROM bars GROUP BY 1, 2",
)
def month_end_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.month_ends(bars(spark, sf_dir)).withColumn("close", F.bround("close", 8))
