"""Amounts as text: rupees in lakh and crore, dollars with thousands. Rounded half up at two decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the two units are worth, and the signs.
LAKH, CRORE = 100_000, 10_000_000
RUPEE, DOLLAR = "₹", "$"


def _cents(amount: Column) -> Column:
    return F.round(amount.cast("decimal(30,8)"), 2).cast("decimal(28,2)")


def _grouped(amount: Column, rest: str) -> Column:
    """Commas where a digit is followed by the last three digits and, before them, whole groups of ``rest``."""
    return F.regexp_replace(amount.cast("string"), rf"(\d)(?=(?:\d{{{rest}}})*\d{{3}}\.)", "$1,")


def inr_text(amount: Column) -> Column:
    """Grouped rupees below a lakh, then n.nn lakh, then n.nn crore."""
    size = F.abs(amount.cast("decimal(30,8)"))
    lakh = _cents(size / LAKH)
    plain, crore = _grouped(_cents(size), "2"), F.concat(_grouped(_cents(size / CRORE), "2"), F.lit(" crore"))
    text = F.when(_cents(size) < LAKH, plain).when(lakh < 100, F.concat(lakh.cast("string"), F.lit(" lakh"))).otherwise(crore)
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit(RUPEE), text)


def usd_text(amount: Column) -> Column:
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit(DOLLAR), _grouped(_cents(F.abs(amount.cast("decimal(30,8)"))), "3"))


def usd_with_inr(usd: Column, rate: Column, rate_date: Column) -> Column:
    """The dollars, and in brackets the rupees with the rate and its date."""
    at = F.concat(F.lit(" at "), _cents(rate).cast("string"), F.lit(" INR/USD on "), rate_date.cast("string"))
    return F.concat(usd_text(usd), F.lit(" ("), inr_text(usd.cast("decimal(20,4)") * rate.cast("decimal(12,4)")), at, F.lit(")"))
