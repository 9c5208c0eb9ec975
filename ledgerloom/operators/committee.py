"""Ceilings on a proposed verdict and weight, as columns: nothing here raises either."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LADDER = ["BUY", "ACCUMULATE", "HOLD", "TRIM", "SELL", "AVOID", "INSUFFICIENT_DATA"]
UPWARD = ["BUY", "ACCUMULATE"]
NO_WEIGHT = ["SELL", "AVOID", "INSUFFICIENT_DATA"]
INSUFFICIENT_BAND = "insufficient_data"


def veto_reasons(excluded: Column, hard_flag: Column, position_over: Column, sector_over: Column, days_to_trade: Column, max_days: float | None = None) -> Column:
    """Why risk objects, in this order; an empty array is no veto. Null facts object to nothing."""
    slow = F.lit(False) if max_days is None else days_to_trade > max_days
    causes = [("excluded_by_profile", excluded), ("hard_red_flag", hard_flag), ("position_over_limit", position_over), ("sector_over_limit", sector_over), ("days_to_trade_over_limit", slow)]
    return F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in causes]))


def weight_cap(max_position: Column, sector_headroom: Column, proposal: Column) -> Column:
    """The smallest of the limits that are known, 0 at least."""
    return F.greatest(F.least(max_position, sector_headroom, proposal), F.lit(0.0))


def coverage_pct(inputs: Column, inputs_total: Column, views: Column, views_required: Column) -> Column:
    """The smaller share, in percent, of inputs and of views; nothing required counts as 0."""
    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)

    return F.least(share(inputs, inputs_total), share(views, views_required))


def verdict_ceiling(proposed: Column, veto: Column, band: Column, capped_at_hold: Column, hard_flag: Column, coverage: Column, least: float) -> Column:
    """INSUFFICIENT_DATA for such a band or too little coverage; else HOLD for an upward verdict that anything caps."""
    short = F.coalesce(band == INSUFFICIENT_BAND, F.lit(False)) | F.coalesce(coverage < least, F.lit(True))
    capped = F.coalesce(veto, F.lit(False)) | F.coalesce(capped_at_hold, F.lit(False)) | F.coalesce(hard_flag, F.lit(False))
    return F.when(short, "INSUFFICIENT_DATA").when(proposed.isin(*UPWARD) & capped, "HOLD").otherwise(proposed)


def final_weight(verdict: Column, proposal: Column, cap: Column, lowered_by_veto: Column) -> Column:
    """The proposal within 0 and the cap; null for a verdict that carries no weight and a hold that a veto made."""
    none = verdict.isin(*NO_WEIGHT) | ((verdict == "HOLD") & F.coalesce(lowered_by_veto, F.lit(False))) | proposal.isNull()
    return F.when(~none, F.least(F.greatest(proposal, F.lit(0.0)), cap))
