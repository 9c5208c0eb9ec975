"""Queries that test rows and series, read stored versions, and keep the books of jobs, caches and members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.stats import r6
from ledgerloom.operators import checks, returns, stored
from ledgerloom.plans.bindings import BARS, bars
from ledgerloom.plans.registry import query, table


@query("q_decimal", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '1,234.5' WHEN 1 THEN ' 77 ' WHEN 2 THEN 'n/a' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE o_orderkey::VARCHAR END AS raw FROM orders)
  SELECT o_orderkey, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'missing' WHEN try_cast(replace(trim(raw), ',', '') AS DECIMAL(38,10)) IS NULL THEN 'not a number' END AS fault FROM t""")
def q_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case o_orderkey % 6 when 0 then '1,234.5' when 1 then ' 77 ' when 2 then 'n/a' when 3 then '' when 4 then null else cast(o_orderkey as string) end")
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.decimal_fault(raw).alias("fault"))


@query("q_audit_row", """SELECT CASE WHEN c_acctbal < 0 THEN 'balance negative' WHEN DATE '2024-01-01' + (c_custkey % 40)::INT > DATE '2024-01-31' THEN 'date in the future' END AS reason, c_mktsegment AS series, count(*) AS rows FROM customer GROUP BY 1, 2 HAVING reason IS NOT NULL""")
def q_audit_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "series")
    fault = checks.value_fault(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 40).cast("int")), F.lit("2024-01-31").cast("date"), balance=F.col("c_acctbal"))
    return checks.audit(rows, fault, "series")


@query("q_series_positive_sorted", """WITH p AS (SELECT user_id AS series, CAST(ts AS DATE) AS date, value - 20 AS v, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), value - 20) AS before FROM events)
  SELECT series, date, CASE WHEN v <= 0 THEN 'not positive' ELSE 'repeated date' END AS reason FROM p WHERE v IS NULL OR v <= 0 OR before = date""")
def q_series_positive_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.to_date("ts").alias("date"), (F.col("value") - 20).alias("v"))
    return checks.series_faults(points, "series", "v")


_SIDES = "p AS (SELECT l_suppkey AS fund, CAST(l_shipdate AS DATE) AS date, l_returnflag AS source, avg(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY ALL)"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("fund"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("source")).agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("value"))


@query("q_nav_disagreement", f"WITH {_SIDES.replace('avg(l_extendedprice::DECIMAL(18,2))::DOUBLE', 'sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*)')} SELECT a.fund, a.date, round_even(a.value, 6) AS value, round_even(b.value, 6) AS other FROM p a JOIN p b ON a.fund = b.fund AND a.date = b.date AND a.source = 'A' AND b.source = 'R' WHERE abs(a.value - b.value) / a.value > 0.2")
def q_nav_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.disagreements(_sides(spark, sf_dir), "fund", "A", "R", 0.2).withColumns({"value": r6(F.col("value")), "other": r6(F.col("other"))})


@query("q_gap_sessions", f"""WITH {BARS}, s AS (SELECT DISTINCT date FROM bars WHERE isodow(date) <= 5), r AS (SELECT security_id, min(date) AS a, max(date) AS b FROM bars GROUP BY 1)
  SELECT security_id, s.date FROM r JOIN s ON s.date BETWEEN a AND b ANTI JOIN bars ON bars.security_id = r.security_id AND bars.date = s.date""")
def q_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bars(spark, sf_dir).select("security_id", "date")
    sessions = own.select("date").distinct().where("dayofweek(date) between 2 and 6")
    return checks.missing_sessions(own, sessions, "security_id")


@query("q_gap_nav_trailing", """WITH l AS (SELECT c_custkey AS fund, DATE '2024-01-01' + (c_custkey % 31)::INT AS last FROM customer), d AS (SELECT fund, list_filter(CAST(generate_series(last + INTERVAL 1 DAY, TIMESTAMP '2024-01-31', INTERVAL 1 DAY) AS DATE[]), lambda d: isodow(d) <= 5) AS days FROM l WHERE last < DATE '2024-01-31')
  SELECT fund, list_min(days) AS gap_from, list_max(days) AS gap_to, len(days)::INT AS days FROM d WHERE len(days) > 4""")
def q_gap_nav_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fund"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 31).cast("int")).alias("date"))
    return checks.trailing_gap(points, "fund", F.lit("2024-01-31").cast("date"), 4)


@query("q_stale_price", "SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND CAST(o_orderdate AS DATE) <= DATE '1996-06-30' AND DATE '1996-06-30' - CAST(o_orderdate AS DATE) <= 10 THEN o_totalprice END AS price FROM orders")
def q_stale_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", returns.usable_price(F.col("o_totalprice"), F.to_date("o_orderdate"), F.lit("1996-06-30").cast("date")).alias("price"))


@query("text_chunk", "SELECT doc_id, md5(substr(text, 401, 300)) AS part, CASE WHEN length(text) > 700 THEN 700 END AS next_cursor FROM documents")
def text_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, after = checks.chunk(F.col("text"), 400, 300)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(part).alias("part"), after.alias("next_cursor"))


@query("status_cache", "SELECT event_type AS adapter, count(*) AS entries, epoch_us(max(ts)::TIMESTAMP) AS newest, TIMESTAMP '2024-02-03 00:00:00' - max(ts)::TIMESTAMP > INTERVAL 4 DAYS AS stale FROM events GROUP BY 1")
def status_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.col("event_type").alias("adapter"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return checks.cache_state(entries, F.lit("2024-02-03 00:00:00"), 4).withColumn("newest", F.unix_micros("newest"))


@query("status_ingest", "SELECT o_orderpriority AS kind, max(CAST(o_orderdate AS DATE)) AS as_of, count(*) AS ingests FROM orders GROUP BY 1")
def status_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ingest of each kind."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.max(F.to_date("o_orderdate")).alias("as_of"), F.count("*").alias("ingests"))


_META = {
    "manager": "CASE WHEN o_orderkey % 5 > 0 THEN left(o_orderpriority, 1) END", "category": "o_orderpriority", "ter": "CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 100000 END",
    "code": "o_orderkey % 3", "name": "CASE WHEN o_orderkey % 16 = 0 THEN 'Merged Growth' ELSE 'Emerging Growth' END", "source": "o_orderstatus",
}


@query("al_mf_changes", f"""WITH m AS (SELECT o_custkey AS fund, CAST(o_orderdate AS DATE) AS as_of, {', '.join(f'max({e}) AS {n}' for n, e in _META.items())} FROM orders GROUP BY 1, 2),
  s AS (SELECT *, lag(manager) OVER w AS m0, lag(category) OVER w AS c0, lag(ter) OVER w AS t0, lag(code) OVER w AS k0, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY fund ORDER BY as_of)),
  c AS (SELECT fund, as_of, unnest(list_filter([CASE WHEN manager IS NOT NULL AND manager IS DISTINCT FROM m0 THEN 'manager' END, CASE WHEN category IS NOT NULL AND category IS DISTINCT FROM c0 THEN 'category' END, CASE WHEN abs(ter - t0) > 0.25 THEN 'ter' END,
    CASE WHEN code IS DISTINCT FROM k0 OR regexp_matches(lower(concat_ws(' ', name, source)), '\\bmerg') THEN 'merger' END], lambda x: x IS NOT NULL)) AS change FROM s WHERE n > 1)
  SELECT * FROM c""")
def al_mf_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as funds, their order days as versions of what is known of them."""
    versions = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("fund"), F.to_date("o_orderdate").alias("as_of")).agg(*[F.max(F.expr(e)).alias(n) for n, e in _META.items()])
    return checks.fund_changes(versions, "fund", 0.25)


@query("fd_trailing_1y", f"""WITH {BARS}, l AS (SELECT security_id, max(date) AS last, max_by(close, date) AS now FROM bars GROUP BY 1),
  t AS (SELECT security_id, max_by(close, date) AS "then" FROM bars JOIN l USING (security_id) WHERE last - date >= 365 GROUP BY 1)
  SELECT security_id, round_even(100 * (now / "then" - 1), 2) AS pct FROM l LEFT JOIN t USING (security_id)""")
def fd_trailing_1y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.trailing_year(bars(spark, sf_dir), "security_id", "close")


@query("sink_members", """WITH old AS (SELECT n_regionkey AS index_id, n_nationkey AS security_id, 'old' AS origin FROM nation), fresh AS (SELECT n_regionkey AS index_id, n_nationkey + 100 AS security_id, 'fresh' AS origin FROM nation WHERE n_regionkey < 2)
  SELECT * FROM old ANTI JOIN fresh USING (index_id) UNION ALL SELECT * FROM fresh""")
def sink_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new snapshot of some indices in place of all that was stored of them."""
    nation = table(spark, sf_dir, "nation")
    old = nation.select(F.col("n_regionkey").alias("index_id"), F.col("n_nationkey").alias("security_id"), F.lit("old").alias("origin"))
    fresh = nation.where("n_regionkey < 2").select(F.col("n_regionkey").alias("index_id"), (F.col("n_nationkey") + 100).alias("security_id"), F.lit("fresh").alias("origin"))
    return stored.replace_partition(old, fresh, ["index_id"])
