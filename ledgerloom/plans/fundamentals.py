"""Queries over statements, valuation and provider figures: nations are companies, order states are items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import r6, ratio
from ledgerloom.operators import fundamentals as fu
from ledgerloom.plans.registry import query, table

PROVIDERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SCENARIOS = [("base", 0.08, 0.12, 0.03), ("bull", 0.12, 0.11, 0.04), ("bear", 0.04, 0.14, 0.02)]


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, year, revenue, net_income, receivables."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("security_id"))
    item = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("price"))).cast("double")
    return orders.join(customers, "o_custkey").groupBy("security_id", "year").agg(item("F").alias("revenue"), item("P").alias("net_income"), item("O").alias("receivables"))


ANNUAL = """
annual AS (
  SELECT c_nationkey AS security_id, year(o_orderdate)::INT AS year, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F')::DOUBLE AS revenue,
    sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'P')::DOUBLE AS net_income, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'O')::DOUBLE AS receivables
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


def _yearly():
    return Window.partitionBy("security_id").orderBy("year")


@query(
    "st_period_kind",
    """SELECT CASE WHEN n BETWEEN 350 AND 380 THEN 'A' WHEN n BETWEEN 80 AND 100 THEN 'Q' WHEN n BETWEEN 170 AND 190 OR n BETWEEN 260 AND 285 THEN 'YTD' ELSE 'other' END AS kind, count(*) AS n_rows
    FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""",
)
def st_period_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("end"))
    starts = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start"))
    return lines.join(starts, "o_orderkey").groupBy(fu.period_kind(F.col("start"), F.col("end")).alias("kind")).agg(F.count("*").alias("n_rows"))


@query(
    "fa_margins",
    f"""WITH {ANNUAL} SELECT security_id, year, round_even(net_income / nullif(revenue, 0), 6) AS net_margin, round_even(365.0::DOUBLE * receivables / nullif(revenue, 0), 6) AS receivable_days,
    CASE WHEN revenue IS NULL THEN 'revenue missing' WHEN net_income IS NULL THEN 'net income missing' END AS reason FROM annual""",
)
def fa_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin, days = ratio(F.col("net_income"), F.col("revenue")), ratio(365.0 * F.col("receivables"), F.col("revenue"))
    reason = F.when(F.col("revenue").isNull(), "revenue missing").when(F.col("net_income").isNull(), "net income missing")
    return annual(spark, sf_dir).select("security_id", "year", r6(margin).alias("net_margin"), r6(days).alias("receivable_days"), reason.alias("reason"))


@query(
    "fa_roe",
    f"""WITH {ANNUAL} SELECT security_id, year, round_even(2.0::DOUBLE * net_income / nullif(receivables + lag(receivables) OVER (PARTITION BY security_id ORDER BY year), 0), 6) AS return_on_average FROM annual""",
)
def fa_roe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income over the mean of this and the last year's balance."""
    both = F.col("receivables") + F.lag("receivables").over(_yearly())
    return annual(spark, sf_dir).select("security_id", "year", r6(ratio(2.0 * F.col("net_income"), both)).alias("return_on_average"))


@query(
    "fa_growth_stdev",
    f"""WITH {ANNUAL}, g AS (SELECT security_id, revenue / nullif(lag(revenue) OVER (PARTITION BY security_id ORDER BY year), 0) - 1 AS growth FROM annual)
    SELECT security_id, count(growth) AS years, round_even(stddev_samp(growth), 6) AS growth_stdev FROM g GROUP BY 1""",
)
def fa_growth_stdev(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = annual(spark, sf_dir).withColumn("growth", ratio(F.col("revenue"), F.lag("revenue").over(_yearly())) - 1)
    return grown.groupBy("security_id").agg(F.count("growth").alias("years"), r6(F.stddev_samp("growth")).alias("growth_stdev"))


@query(
    "red_flags",
    f"""WITH {ANNUAL}, y AS (SELECT *, 365.0::DOUBLE * receivables / nullif(revenue, 0) AS days FROM annual),
    l AS (SELECT *, lag(days) OVER w AS days0, lag(net_income) OVER w AS income0, row_number() OVER (PARTITION BY security_id ORDER BY year DESC) AS k FROM y WINDOW w AS (PARTITION BY security_id ORDER BY year))
    SELECT security_id, 'receivable_days' AS flag, CASE WHEN days0 IS NULL OR days IS NULL OR days0 <= 0 THEN 'not_evaluable' WHEN (days / days0 - 1) * 100 > 30 THEN 'fired' ELSE 'clear' END AS status FROM l WHERE k = 2
    UNION ALL SELECT security_id, 'dilution', CASE WHEN income0 IS NULL OR net_income IS NULL OR income0 <= 0 THEN 'not_evaluable' WHEN (net_income / income0 - 1) * 100 > 5 THEN 'fired' ELSE 'clear' END FROM l WHERE k = 2""",
)
def red_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last full year against the one before: receivable days up by 30 %, shares (here: income) up by 5 %."""
    days = annual(spark, sf_dir).withColumn("days", ratio(365.0 * F.col("receivables"), F.col("revenue")))
    seen = days.withColumns({"days0": F.lag("days").over(_yearly()), "income0": F.lag("net_income").over(_yearly()), "k": F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("year")))}).where("k = 2")
    flags = F.array(
        F.struct(F.lit("receivable_days").alias("flag"), fu.rise_flag(F.col("days0"), F.col("days"), 30.0).alias("status")),
        F.struct(F.lit("dilution").alias("flag"), fu.rise_flag(F.col("income0"), F.col("net_income"), 5.0).alias("status")),
    )
    return seen.select("security_id", F.inline(flags))


def _dcf_sql(growth: str, discount: float, terminal: float) -> str:
    step = f"((1 + {growth}) / {1 + discount}::DOUBLE)"
    return "p_retailprice * (" + " + ".join(f"pow({step}, {k})" for k in range(1, 11)) + f" + pow({step}, 10) * ({(1 + terminal) / (discount - terminal)}::DOUBLE))"


@query("val_dcf", "SELECT p_partkey, " + ", ".join(f"round_even({_dcf_sql(f'{g}::DOUBLE', d, t)}, 6) AS {n}" for n, g, d, t in SCENARIOS) + " FROM part")
def val_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *[r6(fu.discounted_value(F.col("p_retailprice"), F.lit(g), d, t, 10)).alias(n) for n, g, d, t in SCENARIOS])


@query(
    "val_reverse_dcf",
    f"""WITH RECURSIVE s AS (SELECT p_partkey, p_retailprice, p_retailprice * p_size AS cap, -0.5::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS n FROM part
      UNION ALL SELECT p_partkey, p_retailprice, cap, CASE WHEN {_dcf_sql('((lo + hi) / 2)', 0.12, 0.03)} < cap THEN (lo + hi) / 2 ELSE lo END,
        CASE WHEN {_dcf_sql('((lo + hi) / 2)', 0.12, 0.03)} < cap THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM s WHERE n < 80)
    SELECT p_partkey, round_even(CASE WHEN cap >= {_dcf_sql('-0.5::DOUBLE', 0.12, 0.03)} AND cap <= {_dcf_sql('1.0::DOUBLE', 0.12, 0.03)} THEN (lo + hi) / 2 END, 6) AS implied_growth FROM s WHERE n = 80""",
)
def val_reverse_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.col("p_retailprice") * F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", r6(fu.implied_growth(cap, F.col("p_retailprice"), 0.12, 0.03, 10)).alias("implied_growth"))


_MULTIPLES = "m AS (SELECT p_type AS sector, p_brand AS security_id, sum(p_retailprice::DECIMAL(18,2))::DOUBLE / sum(p_size) AS multiple FROM part GROUP BY 1, 2)"


@query(
    "val_peer_median",
    f"""WITH {_MULTIPLES}, p AS (SELECT a.sector, a.security_id, median(b.multiple) AS peer_median, count(*) AS n FROM m a JOIN m b ON a.sector = b.sector AND a.security_id <> b.security_id GROUP BY 1, 2)
    SELECT m.sector, m.security_id, round_even(multiple, 6) AS multiple, round_even(CASE WHEN n >= 3 THEN peer_median END, 6) AS peer_median FROM m LEFT JOIN p USING (sector, security_id)""",
)
def val_peer_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("sector"), F.col("p_brand").alias("security_id"))
    multiples = parts.agg((F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double") / F.sum("p_size")).alias("multiple"))
    return fu.peer_median(multiples, "sector", "multiple", 3).select("sector", "security_id", r6(F.col("multiple")).alias("multiple"), r6(F.col("peer_median")).alias("peer_median"))


@query(
    "xc_compare",
    """WITH f AS (SELECT c_nationkey AS security_id, year(o_orderdate)::INT AS year, o_orderpriority AS source, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
    b AS (SELECT *, first_value(source) OVER w AS base, first_value(value) OVER w AS base_value, count(*) OVER (PARTITION BY security_id, year) AS n FROM f WINDOW w AS (PARTITION BY security_id, year ORDER BY source))
    SELECT security_id, year, source, base, CASE WHEN n = 1 THEN 'only' WHEN source = base THEN 'base' WHEN abs(value - base_value) * 100 <= 25 * abs(base_value) THEN 'match' ELSE 'differs' END AS status FROM b""",
)
def xc_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("security_id")), "o_custkey")
    figures = orders.groupBy("security_id", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("source")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return fu.cross_check(figures, ["security_id", "year"], "source", "value", PROVIDERS, 25.0)


@query(
    "macro_yoy",
    """WITH m AS (SELECT o_orderpriority AS role, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY ALL),
    l AS (SELECT role, max(date) AS last_date, max_by(value, date) AS last_value FROM m GROUP BY 1),
    n AS (SELECT role, arg_min(value, abs(date_diff('day', date, CAST(last_date - INTERVAL 12 MONTH AS DATE)))) AS near FROM m JOIN l USING (role)
      WHERE abs(date_diff('day', date, CAST(last_date - INTERVAL 12 MONTH AS DATE))) <= 20 AND date < last_date GROUP BY 1)
    SELECT role, last_date, last_value, round_even((last_value / nullif(near, 0) - 1) * 100, 6) AS yoy_pct FROM l LEFT JOIN n USING (role)""",
)
def macro_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role"), F.to_date(F.trunc("o_orderdate", "month")).alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return fu.macro_year_change(monthly, "role", "date", "value").withColumn("yoy_pct", r6(F.col("yoy_pct")))


@query(
    "rv_declining",
    f"""WITH {ANNUAL}, t AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY year DESC) AS k, lag(revenue, 1) OVER w AS a, lag(revenue, 2) OVER w AS b FROM annual WINDOW w AS (PARTITION BY security_id ORDER BY year))
    SELECT security_id, CASE WHEN b IS NOT NULL AND a IS NOT NULL AND revenue IS NOT NULL THEN revenue < a AND a < b END AS declining FROM t WHERE k = 1""",
)
def rv_declining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of the last two points is below the one before it."""
    a, b = F.col("a"), F.col("b")
    seen = annual(spark, sf_dir).withColumns({"a": F.lag("revenue", 1).over(_yearly()), "b": F.lag("revenue", 2).over(_yearly()), "k": F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("year")))}).where("k = 1")
    return seen.select("security_id", F.when(a.isNotNull() & b.isNotNull() & F.col("revenue").isNotNull(), (F.col("revenue") < a) & (a < b)).alias("declining"))
