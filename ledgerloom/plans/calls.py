"""Queries over the ledger of calls: which rows are one call, and what became of each at each horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import ledger
from ledgerloom.plans.portfolio import SCORED, calls, scored
from ledgerloom.plans.registry import query


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four orders in turn, the second corrects the first and the third the second; a seventh also corrects an older one."""
    before = F.when((F.col("call_id") % 4).isin(1, 2), F.col("call_id") - 1).when(F.col("call_id") % 7 == 3, F.col("call_id") - 5)
    return calls(spark, sf_dir).withColumn("corrects_id", before)


_FINAL = f"""{SCORED}, c AS (SELECT *, CASE WHEN call_id % 4 IN (1, 2) THEN call_id - 1 WHEN call_id % 7 = 3 THEN call_id - 5 END AS corrects_id FROM calls),
  corr AS (SELECT corrects_id AS call_id, max(call_id) AS later FROM c WHERE corrects_id IN (SELECT call_id FROM c) GROUP BY 1),
  walk AS (SELECT call_id, call_id AS last FROM c UNION ALL SELECT walk.call_id, later FROM walk JOIN corr ON walk.last = corr.call_id),
  ends AS (SELECT * FROM walk WHERE last NOT IN (SELECT call_id FROM corr)),
  live AS (SELECT * FROM c WHERE call_id NOT IN (SELECT call_id FROM corr)),
  d1 AS (SELECT security_id, verdict, date, max(call_id) AS latest FROM live GROUP BY ALL),
  r1 AS (SELECT *, row_number() OVER (PARTITION BY security_id, verdict ORDER BY date) AS n FROM d1),
  w1 AS (SELECT *, date AS started, latest AS head FROM r1 WHERE n = 1
    UNION ALL SELECT r1.*, CASE WHEN r1.date < w1.started + 91 THEN w1.started ELSE r1.date END, CASE WHEN r1.date < w1.started + 91 THEN w1.head ELSE r1.latest END FROM w1 JOIN r1 ON r1.security_id = w1.security_id AND r1.verdict = w1.verdict AND r1.n = w1.n + 1),
  final AS (
    SELECT ends.call_id, head AS final_id, CASE WHEN ends.call_id <> last THEN 'corrected' WHEN ends.call_id = head THEN 'kept' WHEN ends.call_id = latest THEN 'in_window' ELSE 'same_day' END AS why
    FROM ends JOIN live ON live.call_id = last JOIN w1 ON w1.security_id = live.security_id AND w1.verdict = live.verdict AND w1.date = live.date)""".replace("WITH ", "WITH RECURSIVE ", 1)


@query("led_survivors", _FINAL + " SELECT * FROM final")
def led_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.survivors(ledger_rows(spark, sf_dir), 91)


@query(
    "led_load_scored",
    _FINAL
    + """, acted AS (SELECT DISTINCT final_id AS call_id FROM final WHERE call_id % 10 IN (0, 3))
    SELECT k.call_id, weeks, k.verdict, CASE WHEN weeks = 13 THEN status ELSE 'pending' END AS status, CASE WHEN weeks = 13 THEN round_even(excess, 4) END AS call_excess, CASE WHEN weeks = 13 THEN excess > 0 END AS hit,
      k.call_id IN (SELECT call_id FROM acted) AS acted
    FROM final f JOIN s k ON k.call_id = f.call_id, (SELECT unnest([13, 26]) AS weeks) WHERE f.call_id = f.final_id""",
)
def led_load_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that count at 13 weeks, as scored, and at 26, not scored yet; a tenth each are acted on or in part."""
    rows = ledger_rows(spark, sf_dir)
    decision = F.when(F.col("call_id") % 10 == 0, "acted").when(F.col("call_id") % 10 == 3, "partial").otherwise("rejected")
    scores = scored(spark, sf_dir).select("call_id", F.lit(13).alias("weeks"), "status", "call_excess", "hit")
    found = ledger.scored_calls(rows, ledger.survivors(rows, 91), scores, rows.select("call_id", decision.alias("decision")), (13, 26))
    return found.withColumn("call_excess", F.bround("call_excess", 4))
