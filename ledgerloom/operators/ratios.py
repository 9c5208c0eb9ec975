"""Ratios of one fiscal year's items, each with the reason why it is null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that banks file and others don't.
BANK_ITEMS = ["gnpa_pct", "nnpa_pct", "nim_pct", "casa_pct", "car_pct"]


def _over(needs: list[str], top: Column, bottom: Column, scale: float, why: str, positive: bool = True) -> tuple[Column, Column]:
    """top / bottom * scale if all of ``needs`` are filed and bottom is positive (or, else, not zero)."""
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in needs]))
    bad = bottom <= 0 if positive else bottom == 0
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("no "), F.array_join(missing, ", "))).when(bad, why)
    return F.when(reason.isNull(), top / bottom * scale), reason


def general(default_tax_pct: float = 25.0) -> dict[str, tuple[Column, Column]]:
    """Sixteen ratios over item columns; a fiscal year is a row.

    Capital is debt and equity less cash, EBITDA is operating income and depreciation, goods cost revenue less gross
    profit. The tax rate is that of the filing where it lies between 0 and 100 %, else the default.
    """
    c = F.col
    filed = (c("pretax_income") > 0) & c("income_tax").between(F.lit(0), c("pretax_income"))
    tax = F.when(filed, c("income_tax") / c("pretax_income")).otherwise(default_tax_pct / 100)
    ebitda, goods = c("operating_income") + c("depreciation_amortization"), c("revenue") - c("gross_profit")

    def pct(top: Column, bottom: Column, needs: list[str], name: str) -> tuple[Column, Column]:
        return _over(needs, top, bottom, 100.0, f"{name} is zero", positive=False)

    out = {
        "gross_margin_pct": pct(c("gross_profit"), c("revenue"), ["gross_profit", "revenue"], "revenue"),
        "operating_margin_pct": pct(c("operating_income"), c("revenue"), ["operating_income", "revenue"], "revenue"),
        "ebitda_margin_pct": pct(ebitda, c("revenue"), ["operating_income", "depreciation_amortization", "revenue"], "revenue"),
        "roic_pct": _over(["operating_income", "total_debt", "total_equity", "cash"], c("operating_income") * (1 - tax), c("total_debt") + c("total_equity") - c("cash"), 100.0, "capital is not positive"),
        "roce_pct": pct(c("operating_income"), c("total_assets") - c("current_liabilities"), ["operating_income", "total_assets", "current_liabilities"], "capital employed"),
        "net_debt_ebitda": _over(["total_debt", "cash", "operating_income", "depreciation_amortization"], c("total_debt") - c("cash"), ebitda, 1.0, "ebitda is not positive"),
        "debt_equity": _over(["total_debt", "total_equity"], c("total_debt"), c("total_equity"), 1.0, "equity is not positive"),
        "interest_cover": _over(["operating_income", "interest_expense"], c("operating_income"), F.abs("interest_expense"), 1.0, "interest is zero", positive=False),
        "current_ratio": _over(["current_assets", "current_liabilities"], c("current_assets"), c("current_liabilities"), 1.0, "current liabilities are zero", positive=False),
        "cfo_to_pat": _over(["cfo", "net_income"], c("cfo"), c("net_income"), 1.0, "net income is not positive"),
        "fcf_margin_pct": pct(c("cfo") - c("capex"), c("revenue"), ["cfo", "capex", "revenue"], "revenue"),
        "accruals_ratio_pct": pct(c("net_income") - c("cfo"), c("total_assets"), ["net_income", "cfo", "total_assets"], "total assets"),
        "receivable_days": _over(["receivables", "revenue"], c("receivables"), c("revenue"), 365.0, "revenue is zero", positive=False),
        "inventory_days": _over(["inventory", "revenue", "gross_profit"], c("inventory"), goods, 365.0, "cost of goods is not positive"),
        "payable_days": _over(["payables", "revenue", "gross_profit"], c("payables"), goods, 365.0, "cost of goods is not positive"),
    }
    days = out["receivable_days"][0] + out["inventory_days"][0] - out["payable_days"][0]
    return out | {"working_capital_days": (days, F.when(days.isNull(), "needs receivable, inventory and payable days"))}


def bank() -> dict[str, tuple[Column, Column]]:
    return {i: (F.col(i), F.when(F.col(i).isNull(), f"no {i}")) for i in BANK_ITEMS}


def is_financial(sector: Column, sectors: list[str]) -> Column:
    """By its sector, or by any item that only banks file."""
    filed = F.coalesce(*[F.col(i) for i in BANK_ITEMS]).isNotNull()
    return F.coalesce(sector.isin(*sectors), F.lit(False)) | filed


def coverage(cells: Mapping[str, tuple[Column, Column]]) -> Column:
    """The share of ratios that are known, in percent at two decimals."""
    known = sum((value.isNotNull().cast("int") for value, _ in cells.values()), F.lit(0))
    return F.bround(100.0 * known / len(cells), 2)
