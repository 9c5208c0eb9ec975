"""Queries over bars that need whole histories: all indicator cells, levels, setups, portfolio risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import r6
from ledgerloom.operators import indicators as ta
from ledgerloom.operators import risk, setups
from ledgerloom.plans.bindings import BARS, bars, benchmark
from ledgerloom.plans.registry import query, table

CELLS = [
    "sma_20", "sma_50", "sma_200", "ema_21", "slope_50dma_pct", "price_vs_sma200_pct", "weekly_trend", "rsi_14", "macd", "macd_signal", "macd_hist", "roc_3m", "roc_6m", "roc_12m",
    "dist_52w_high_pct", "dist_52w_low_pct", "atr_14", "atr_pct", "vol_20d", "vol_60d", "boll_width_20", "avg_volume_20", "updown_volume_ratio_20",
    "rs_benchmark_ratio", "rs_benchmark_change_6m_pct", "rs_sector_ratio", "rs_sector_change_6m_pct",
]

W = "OVER (PARTITION BY security_id ORDER BY date"


def _number():
    return F.expr("cast(substring(security_id, 7) as int)")


def sector_closes(own: DataFrame) -> DataFrame:
    """security_id, date, sector_close: the mean close of every fifth brand."""
    return own.select("security_id", "date", F.avg("close").over(Window.partitionBy(_number() % 5, "date")).alias("sector_close"))


def _rows(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _ema_sql(c: str, n: int) -> str:
    return f"CASE WHEN len({c}) >= {n} THEN list_reduce(list_prepend(list_sum({c}[1:{n}]) / {n}, {c}[{n + 1}:]), lambda a, x: a + (2.0::DOUBLE / {n + 1}) * (x - a)) END"


def _emas_sql(c: str, n: int) -> str:
    return f"CASE WHEN len({c}) >= {n} THEN list_reduce(list_prepend([list_sum({c}[1:{n}]) / {n}], list_transform({c}[{n + 1}:], lambda x: [x])), lambda a, x: list_append(a, a[len(a)] + (2.0::DOUBLE / {n + 1}) * (x[1] - a[len(a)]))) END"


def _wilder_sql(c: str) -> str:
    return f"CASE WHEN len({c}) >= 14 THEN list_reduce(list_prepend(list_sum({c}[1:14]) / 14, {c}[15:]), lambda a, x: (a * 13 + x) / 14) END"


def _relative_sql(name: str, source: str, base: str) -> str:
    return f"""{name} AS (SELECT security_id, ratio AS rs_{name}_ratio, 100 * (ratio / before - 1) AS rs_{name}_change_6m_pct FROM (
      SELECT security_id, close / {base} AS ratio, lag(close / {base}, 126) {W}) AS before, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM {source}) WHERE k = 1)"""


_ALL_CELLS = f"""WITH {BARS},
  m AS (SELECT *, close / lag(close) {W}) - 1 AS ret, close - lag(close) {W}) AS move, lag(close) {W}) AS pc, avg(close) {_rows(50)} AS a50, count(*) {W} ROWS UNBOUNDED PRECEDING) AS n,
    avg(close) OVER (PARTITION BY CAST(substring(security_id, 7) AS INT) % 5, date) AS sector_close FROM bars),
  c AS (SELECT security_id, date, close, n, avg(close) {_rows(20)} AS a20, a50, avg(close) {_rows(200)} AS a200, lag(a50, 20) {W}) AS a50b, close / lag(close, 63) {W}) - 1 AS roc_3m,
    close / lag(close, 126) {W}) - 1 AS roc_6m, close / lag(close, 252) {W}) - 1 AS roc_12m, max(high) {_rows(252)} AS top, min(low) {_rows(252)} AS bottom,
    stddev_samp(ret) {_rows(20)} AS v20, stddev_samp(ret) {_rows(60)} AS v60, stddev_pop(close) {_rows(20)} AS sd, avg(volume) {_rows(20)} AS av,
    sum(CASE WHEN move > 0 THEN volume ELSE 0 END) {_rows(20)} AS up, sum(CASE WHEN move < 0 THEN volume ELSE 0 END) {_rows(20)} AS down, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM m),
  s AS (SELECT security_id, list(close ORDER BY date) AS c, list(move ORDER BY date) FILTER (move IS NOT NULL) AS mv, list(greatest(high - low, abs(high - pc), abs(low - pc)) ORDER BY date) FILTER (pc IS NOT NULL) AS tr FROM m GROUP BY 1),
  e AS (SELECT *, {_emas_sql('c', 12)} AS quick, {_emas_sql('c', 26)} AS late, list_transform(mv, lambda x: greatest(x, 0.0)) AS u, list_transform(mv, lambda x: greatest(-x, 0.0)) AS d FROM s),
  f AS (SELECT *, list_transform(range(1, len(late) + 1), lambda i: quick[i + 14] - late[i]) AS line, {_wilder_sql('u')} AS up14, {_wilder_sql('d')} AS down14 FROM e),
  r AS (SELECT security_id, {_ema_sql('c', 21)} AS ema_21, CASE WHEN up14 + down14 > 0 THEN 100.0 * up14 / (up14 + down14) END AS rsi_14, CASE WHEN len(c) >= 34 THEN line[len(line)] END AS macd, {_ema_sql('line', 9)} AS macd_signal, {_wilder_sql('tr')} AS atr_14 FROM f),
  w0 AS (SELECT security_id, date_trunc('week', date) AS week, max_by(close, date) AS close FROM bars GROUP BY 1, 2),
  w AS (SELECT security_id, CASE WHEN n = 40 THEN sign(a - b)::DOUBLE END AS trend FROM (SELECT security_id, avg(close) OVER (PARTITION BY security_id ORDER BY week ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a,
    avg(close) OVER (PARTITION BY security_id ORDER BY week ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS b, count(*) OVER (PARTITION BY security_id ORDER BY week ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS n,
    row_number() OVER (PARTITION BY security_id ORDER BY week DESC) AS k FROM w0) WHERE k = 1),
  {_relative_sql('benchmark', '(SELECT * FROM m JOIN bench USING (date))', 'benchmark')}, {_relative_sql('sector', 'm', 'sector_close')},
  z AS (SELECT c.security_id, c.date, n AS n_bars, CASE WHEN n >= 20 THEN a20 END AS sma_20, CASE WHEN n >= 50 THEN a50 END AS sma_50, CASE WHEN n >= 200 THEN a200 END AS sma_200, ema_21, CASE WHEN n >= 70 THEN 100 * (a50 / a50b - 1) END AS slope_50dma_pct,
    CASE WHEN n >= 200 THEN 100 * (close / a200 - 1) END AS price_vs_sma200_pct, CASE WHEN n >= 200 THEN trend END AS weekly_trend, rsi_14, macd, macd_signal, macd - macd_signal AS macd_hist, roc_3m, roc_6m, roc_12m,
    CASE WHEN n >= 252 THEN 100 * (close - top) / top END AS dist_52w_high_pct, CASE WHEN n >= 252 THEN 100 * (close - bottom) / bottom END AS dist_52w_low_pct, atr_14, 100 * atr_14 / close AS atr_pct, CASE WHEN n >= 21 THEN v20 * sqrt(252.0) END AS vol_20d,
    CASE WHEN n >= 61 THEN v60 * sqrt(252.0) END AS vol_60d, CASE WHEN n >= 20 THEN 4.0 * sd / a20 END AS boll_width_20, CASE WHEN n >= 20 THEN av END AS avg_volume_20, CASE WHEN n >= 21 THEN up / nullif(down, 0) END AS updown_volume_ratio_20,
    rs_benchmark_ratio, rs_benchmark_change_6m_pct, rs_sector_ratio, rs_sector_change_6m_pct
    FROM c JOIN r USING (security_id) JOIN w USING (security_id) LEFT JOIN benchmark USING (security_id) LEFT JOIN sector USING (security_id) WHERE c.k = 1)
  SELECT security_id, date, n_bars, {', '.join(f'round_even({x}, 6) AS {x}' for x in CELLS)} FROM z"""


@query("ta_compute", _ALL_CELLS)
def ta_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator cell of the last bar of each security."""
    own = bars(spark, sf_dir)
    return ta.all_cells(own, benchmark(spark, sf_dir), sector_closes(own)).select("security_id", "date", "n_bars", *[r6(F.col(c)).alias(c) for c in CELLS])


@query("lv_levels")
def lv_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setups.levels(bars(spark, sf_dir))


@query("st_classify_setup")
def st_classify_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setups.setups(bars(spark, sf_dir))


_PATH = f"""WITH {BARS}, h AS (SELECT DISTINCT p_brand AS security_id, CAST(substring(p_brand, 7) AS INT) // 2 AS portfolio, CASE CAST(substring(p_brand, 7) AS INT) % 2 WHEN 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM part),
  j AS (SELECT *, count(*) OVER (PARTITION BY portfolio, date) AS n FROM bars JOIN h USING (security_id)),
  v AS (SELECT * FROM j JOIN (SELECT portfolio, count(*) AS size FROM h GROUP BY 1) USING (portfolio) WHERE n = size),
  q AS (SELECT portfolio, date, weight * (close / lag(close) OVER (PARTITION BY portfolio, security_id ORDER BY date) - 1) AS r FROM v),
  p AS (SELECT portfolio, date, sum(r) AS ret FROM q WHERE r IS NOT NULL GROUP BY 1, 2),
  t AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY date DESC) AS k FROM p)"""


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("security_id")).distinct()
    holdings = names.select("security_id", F.floor(_number() / 2).cast("int").alias("portfolio"), F.when(_number() % 2 == 0, 0.6).otherwise(0.4).alias("weight"))
    return risk.shared_path(bars(spark, sf_dir), holdings)


@query("rk_volatility", _PATH + " SELECT portfolio, count(*) AS days, round_even(CASE WHEN count(*) >= 60 THEN stddev_samp(ret) * sqrt(252.0) END, 6) AS volatility FROM t WHERE k <= 252 GROUP BY 1")
def rk_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.volatility(_path(spark, sf_dir)).withColumn("volatility", r6(F.col("volatility")))


@query(
    "rk_drawdown",
    _PATH
    + """, l AS (SELECT portfolio, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio ORDER BY date)) AS level FROM t WHERE k <= 252),
    g AS (SELECT portfolio, level, greatest(1.0, max(level) OVER (PARTITION BY portfolio ORDER BY date)) AS peak FROM l)
    SELECT portfolio, count(*) AS days, round_even(CASE WHEN count(*) >= 252 THEN 100 * max((peak - level) / peak) END, 6) AS drawdown_pct FROM g GROUP BY 1""",
)
def rk_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.path_drawdown(_path(spark, sf_dir), 252).withColumn("drawdown_pct", r6(F.col("drawdown_pct")))


@query(
    "rk_days_to_trade",
    f"""WITH {BARS}, c AS (SELECT security_id, close, avg(volume) {_rows(20)} AS av, count(*) {_rows(20)} AS n, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM bars),
    z AS (SELECT p_brand AS security_id, sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS size FROM part GROUP BY 1)
    SELECT security_id, round_even(size / (0.1::DOUBLE * (CASE WHEN n = 20 THEN av * close END)), 6) AS days FROM c JOIN z USING (security_id) WHERE k = 1""",
)
def rk_days_to_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = Window.partitionBy("security_id").orderBy(F.desc("date"))
    adv = bars(spark, sf_dir).select("security_id", (ta.sma(20, "volume") * F.col("close")).alias("adv"), F.row_number().over(last).alias("k")).where("k = 1")
    size = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("security_id")).agg(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("size"))
    return adv.join(size, "security_id").select("security_id", r6(risk.days_to_trade(F.col("size"), F.col("adv"))).alias("days"))


@query(
    "rk_pro_forma",
    """WITH h AS (SELECT s_nationkey AS portfolio, s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN 'S' || (s_suppkey % 4) END AS sector, s_acctbal AS value FROM supplier WHERE s_acctbal > 0),
    c AS (SELECT DISTINCT portfolio, 'candidate' AS name, 'S0' AS sector, 10.0::DOUBLE AS weight FROM h),
    r AS (SELECT portfolio, name, coalesce(sector, 'unclassified') AS sector, value / sum(value) OVER (PARTITION BY portfolio) * 90 AS weight FROM h UNION ALL SELECT * FROM c),
    s AS (SELECT portfolio, sector, sum(weight) AS weight FROM r GROUP BY 1, 2),
    a AS (SELECT portfolio, sum(pow(weight / 100, 2)) AS hhi, coalesce(string_agg(name, ',' ORDER BY name) FILTER (weight > 20), '') AS names_over FROM r GROUP BY 1),
    b AS (SELECT portfolio, coalesce(string_agg(sector, ',' ORDER BY sector) FILTER (weight > 40 AND sector <> 'unclassified'), '') AS sectors_over FROM s GROUP BY 1)
    SELECT portfolio, round_even(hhi, 6) AS hhi, round_even(1 / hhi, 6) AS effective, names_over, sectors_over FROM a JOIN b USING (portfolio)""",
)
def rk_pro_forma(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("portfolio"), F.col("s_name").alias("name"), F.expr("case when s_suppkey % 7 <> 0 then concat('S', s_suppkey % 4) end").alias("sector"), F.col("s_acctbal").alias("value"))
    candidates = held.select("portfolio", F.lit("candidate").alias("name"), F.lit("S0").alias("sector"), F.lit(10.0).alias("weight")).distinct()
    found = risk.pro_forma(held, candidates, 20.0, 40.0)
    return found.select("portfolio", r6(F.col("hhi")).alias("hhi"), r6(F.col("effective")).alias("effective"), F.array_join("names_over", ",").alias("names_over"), F.array_join("sectors_over", ",").alias("sectors_over"))
