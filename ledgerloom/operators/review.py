"""Discipline rules and tax of lots, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may be done with a holding, from most to least; a review only ever moves down it.
ACTIONS = ["ADD", "HOLD", "REVIEW", "TRIM", "EXIT"]


def criterion_status(value: Column, comparator: Column, threshold: Column) -> Column:
    """met, not_met or unknown."""
    hit = F.when(comparator == "lt", value < threshold).when(comparator == "lte", value <= threshold).when(comparator == "gt", value > threshold).when(comparator == "gte", value >= threshold)
    return F.when(hit.isNull(), "unknown").when(hit, "met").otherwise("not_met")


def merged_status(machine: Column, computed: Column, said: Column) -> Column:
    """What was computed counts; where nothing could be, a said not_met becomes unknown. Text criteria stay as said."""
    return F.when(~machine, said).when(computed != "unknown", computed).when(said == "not_met", "unknown").otherwise(said)


def action_floor(proposed: Column, hard: Column, soft: Column, override: Column) -> Column:
    """The proposal lowered to TRIM by a hard cause, to REVIEW by a soft one or a hard one with an override reason."""
    ladder = F.array(*[F.lit(a) for a in ACTIONS])
    lifted = F.coalesce(F.trim(override) != "", F.lit(False))
    cap = F.when(hard & lifted, ACTIONS.index("REVIEW")).when(hard, ACTIONS.index("TRIM")).when(soft, ACTIONS.index("REVIEW")).otherwise(0)
    return F.get(ladder, F.greatest(F.array_position(ladder, proposed).cast("int") - 1, cap))


def lot_tax(price: Column, cost: Column, quantity: Column, days: Column, long_days: int | None, short_pct: float | None, long_pct: float | None) -> dict[str, Column]:
    """long_term, days_to_long, gain, tax_now, tax_long, saving; null where a rate, threshold or cost isn't set. Losses owe nothing."""
    none = F.lit(None).cast("double")

    def owed(gain: Column, pct: float | None) -> Column:
        return none if pct is None else F.greatest(gain, F.lit(0.0)) * pct / 100

    gain = (price - cost) * quantity
    term = F.lit(None).cast("boolean") if long_days is None else days >= long_days
    now, later = F.when(term, owed(gain, long_pct)).when(~term, owed(gain, short_pct)), owed(gain, long_pct)
    later = F.when(term.isNotNull(), later)
    return {"long_term": term, "days_to_long": none.cast("int") if long_days is None else F.greatest(F.lit(long_days) - days, F.lit(0)), "gain": gain, "tax_now": now, "tax_long": later, "saving": now - later}


def exit_load(value: Column, held_days: Column, percent: float, days: int) -> Column:
    """The load on a lot that is held for fewer days."""
    return F.when(held_days < days, value * percent / 100).otherwise(0.0)


def triggers(c: dict[str, Column], percentile_floor: float, sessions: int) -> dict[str, Column]:
    """Six rules, each triggered, clear, not_evaluable or not_applicable.

    ``c``: ``met`` and ``unknown`` (numbers of kill criteria; null without a thesis), ``revenue_falls`` and
    ``margin_falls`` (booleans over the last quarters), ``percentile``, ``revisions``, ``position``, ``max_position``,
    ``sector``, ``max_sector``, ``positional``, ``below`` (sessions under the average), ``rs_change``.
    """
    def rule(*cases: tuple[Column, str], otherwise: str) -> Column:
        out = F.lit(otherwise)
        for condition, state in reversed(cases):
            out = F.when(F.coalesce(condition, F.lit(False)), state).otherwise(out)
        return out

    unknown = "not_evaluable"
    return {
        "thesis": rule((c["met"].isNull(), unknown), (c["met"] > 0, "triggered"), (c["unknown"] > 0, unknown), otherwise="clear"),
        "operations": rule((c["revenue_falls"].isNull() | c["margin_falls"].isNull(), unknown), (c["revenue_falls"] & c["margin_falls"], "triggered"), otherwise="clear"),
        "valuation": rule((c["percentile"].isNull(), unknown), (c["percentile"] <= percentile_floor, "clear"), (c["revisions"].isNull(), unknown), (c["revisions"] <= 0, "triggered"), otherwise="clear"),
        "limits": rule((c["position"] > c["max_position"], "triggered"), (c["sector"] > c["max_sector"], "triggered"), (c["position"].isNull() | c["sector"].isNull(), unknown), otherwise="clear"),
        "trend": rule((~c["positional"], "not_applicable"), (c["below"].isNull(), unknown), (c["below"] < sessions, "clear"), (c["rs_change"].isNull(), unknown), (c["rs_change"] < 0, "triggered"), otherwise="clear"),
        # what else the money could do isn't known to a review
        "alternative": F.lit(unknown),
    }
