"""Queries over ratios, universes and exposures: parts are fiscal years, brands securities, suppliers positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.stats import r6
from ledgerloom.operators import pit, ratios, rebalance, universe
from ledgerloom.plans.bindings import BARS, bars
from ledgerloom.plans.registry import query, table

_NAMES = ["revenue", "gross_profit", "operating_income", "depreciation_amortization", "pretax_income", "income_tax", "net_income", "total_debt", "total_equity", "cash", "total_assets", "current_assets", "current_liabilities", "interest_expense", "cfo", "capex", "receivables", "inventory", "payables"]
_STEPS = [7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79]
_ITEMS = {n: f"CASE WHEN p_partkey % {i + 5} <> 0 THEN CAST(p_partkey * {k} % 97 - {i % 5} AS DOUBLE) END" for i, (n, k) in enumerate(zip(_NAMES, _STEPS, strict=True))}

_SQL_RATIOS = {
    "gross_margin_pct": "100 * gross_profit / nullif(revenue, 0)", "operating_margin_pct": "100 * operating_income / nullif(revenue, 0)", "ebitda_margin_pct": "100 * (operating_income + depreciation_amortization) / nullif(revenue, 0)",
    "roic_pct": "CASE WHEN total_debt + total_equity - cash > 0 THEN 100 * operating_income * (1 - CASE WHEN pretax_income > 0 AND income_tax BETWEEN 0 AND pretax_income THEN income_tax / pretax_income ELSE 0.25::DOUBLE END) / (total_debt + total_equity - cash) END",
    "roce_pct": "100 * operating_income / nullif(total_assets - current_liabilities, 0)", "net_debt_ebitda": "CASE WHEN operating_income + depreciation_amortization > 0 THEN (total_debt - cash) / (operating_income + depreciation_amortization) END",
    "debt_equity": "CASE WHEN total_equity > 0 THEN total_debt / total_equity END", "interest_cover": "operating_income / nullif(abs(interest_expense), 0)", "current_ratio": "current_assets / nullif(current_liabilities, 0)",
    "cfo_to_pat": "CASE WHEN net_income > 0 THEN cfo / net_income END", "fcf_margin_pct": "100 * (cfo - capex) / nullif(revenue, 0)", "accruals_ratio_pct": "100 * (net_income - cfo) / nullif(total_assets, 0)",
    "receivable_days": "365 * receivables / nullif(revenue, 0)", "inventory_days": "CASE WHEN revenue - gross_profit > 0 THEN 365 * inventory / (revenue - gross_profit) END", "payable_days": "CASE WHEN revenue - gross_profit > 0 THEN 365 * payables / (revenue - gross_profit) END",
}


@query(
    "fa_general_metrics",
    f"""WITH i AS (SELECT p_partkey AS security_id, {', '.join(f'{e} AS {n}' for n, e in _ITEMS.items())} FROM part), r AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _SQL_RATIOS.items())} FROM i),
    w AS (SELECT *, receivable_days + inventory_days - payable_days AS working_capital_days FROM r)
    SELECT security_id, {', '.join(f'round_even({n}, 6) + 0.0 AS {n}' for n in [*_SQL_RATIOS, 'working_capital_days'])},
      CASE WHEN total_debt IS NULL AND total_equity IS NULL THEN 'no total_debt, total_equity' WHEN total_debt IS NULL THEN 'no total_debt' WHEN total_equity IS NULL THEN 'no total_equity' WHEN total_equity <= 0 THEN 'equity is not positive' END AS debt_equity_reason,
      round_even(100.0::DOUBLE * len(list_filter([{', '.join([*_SQL_RATIOS, 'working_capital_days'])}], lambda x: x IS NOT NULL)) / 16, 2) AS coverage_pct FROM w""",
)
def fa_general_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as security_id", *[f"{e} as {n}" for n, e in _ITEMS.items()])
    cells = ratios.general()
    return rows.select("security_id", *[r6(value).alias(n) for n, (value, _) in cells.items()], cells["debt_equity"][1].alias("debt_equity_reason"), ratios.coverage(cells).alias("coverage_pct"))


@query(
    "un_build",
    f"""WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS k FROM bars),
    a AS (SELECT security_id, max(date) AS last_bar, max_by(close, date) AS close, avg(volume) AS mean, count(volume) AS n FROM k WHERE k <= 20 GROUP BY 1),
    v AS (SELECT security_id, last_bar, CASE WHEN n = 20 THEN mean * close END AS adv FROM a)
    SELECT security_id, round_even(adv, 6) AS adv, CASE WHEN lower(security_id) IN ('brand#3', 'brand#7') THEN 'excluded' WHEN adv IS NULL THEN 'insufficient liquidity data' WHEN date_diff('day', last_bar, DATE '2001-11-05') > 35 THEN 'last bar is too old' WHEN adv < 40000 THEN 'below the liquidity floor' END AS removed,
      CASE WHEN adv IS NULL THEN 'unclassified' WHEN adv >= 60000 THEN 'large' WHEN adv >= 45000 THEN 'mid' ELSE 'small' END AS bucket FROM v""",
)
def un_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = universe.average_value(bars(spark, sf_dir))
    out = universe.names_excluded(["BRAND#3 ", "brand#7"], F.col("security_id"))
    why = universe.removal(F.col("adv"), F.col("last_bar"), F.to_date(F.lit("2001-11-05")), F.lit(40000.0), F.lit(35), out)
    return found.select("security_id", r6(F.col("adv")).alias("adv"), why.alias("removed"), universe.cap_bucket(F.col("adv"), 60000.0, 45000.0).alias("bucket"))


@query(
    "pf_exposure",
    """WITH r AS (SELECT s_nationkey AS portfolio, CASE s_suppkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'INR' END AS currency, CASE WHEN s_suppkey % 37 <> 0 THEN abs(s_acctbal) END AS value FROM supplier),
    s AS (SELECT portfolio, currency, sum(value) AS value, count(*) FILTER (value IS NULL) AS unknown FROM r GROUP BY 1, 2),
    w AS (SELECT *, bool_or(currency <> 'INR') OVER p AS away, sum(unknown) OVER p AS gaps, sum(value) OVER p AS total FROM s WINDOW p AS (PARTITION BY portfolio))
    SELECT portfolio, currency, round_even(CASE WHEN unknown = 0 THEN value END, 6) AS value, round_even(CASE WHEN gaps = 0 AND total > 0 THEN 100 * value / total END, 6) AS pct FROM w WHERE away""",
)
def pf_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_nationkey as portfolio", "case s_suppkey % 3 when 0 then 'USD' when 1 then 'EUR' else 'INR' end as currency", "case when s_suppkey % 37 <> 0 then abs(s_acctbal) end as value")
    return universe.currency_exposure(rows).withColumns({c: r6(F.col(c)) for c in ("value", "pct")})


@query(
    "mf_history_compare",
    f"""WITH {BARS}, m AS (SELECT security_id AS fund, CAST(date_trunc('month', date) AS DATE) AS month, max_by(close, date) AS multiple FROM bars GROUP BY 1, 2), c AS (SELECT fund, max_by(multiple, month) AS current FROM m GROUP BY 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY month DESC) AS k FROM m), s AS (SELECT fund, count(*) AS months, median(multiple) AS m FROM k WHERE k <= 36 AND multiple > 0 GROUP BY 1),
    r AS (SELECT fund, months, CASE WHEN months >= 24 THEN m END AS median, round_even(CASE WHEN months >= 24 THEN current / m END, 4) AS ratio FROM c JOIN s USING (fund))
    SELECT fund, months, round_even(median, 6) AS median, ratio, CASE WHEN ratio > 1.25 THEN 'expensive' WHEN ratio * 1.25 < 1 THEN 'cheap' WHEN ratio IS NOT NULL THEN 'in range' END AS label FROM r""",
)
def mf_history_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = pit.month_ends(bars(spark, sf_dir)).select(F.col("security_id").alias("fund"), "month", F.col("close").alias("multiple"))
    current = months.groupBy("fund").agg(F.max_by("multiple", "month").alias("current"))
    return universe.history_compare(months, current).withColumn("median", r6(F.col("median")))


@query("rb_propose")
def rb_propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' suppliers as positions of three classes, with equal targets and some cash."""
    money = "decimal(28,2)"
    held = table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr(
        "s_nationkey as portfolio", "element_at(array('debt', 'equity', 'gold'), cast(s_suppkey % 3 as int) + 1) as class", "s_name as key", f"cast(s_acctbal as {money}) as value",
        "case s_suppkey % 10 when 0 then 'EXIT' when 1 then 'TRIM' end as flag", "case when s_suppkey % 4 <> 0 then cast(s_suppkey % 7 as decimal(10,4)) / 100 end as tax_per_unit",
    )
    targets = held.select("portfolio").distinct().selectExpr("portfolio", "inline(transform(array('debt', 'equity', 'gold'), (c, i) -> struct(c as class, cast(element_at(array(30, 50, 20), i + 1) as decimal(10,2)) as target_pct)))")
    settings = held.select("portfolio").distinct().selectExpr("portfolio", f"cast(5 as {money}) as band", f"cast(1000 as {money}) as cash", f"cast(30 as {money}) as turnover_pct", f"cast(0 as {money}) as sold")
    return rebalance.propose(held, targets, settings)
