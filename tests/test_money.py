"""Amounts as text."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money


@pytest.mark.parametrize(
    "amount,inr,usd",
    [
        ("0", "₹0.00", "$0.00"), ("999.995", "₹1,000.00", "$1,000.00"), ("12345.678", "₹12,345.68", "$12,345.68"), ("-99999.99", "-₹99,999.99", "-$99,999.99"), ("99999.995", "₹1.00 lakh", "$100,000.00"),
        ("1234567", "₹12.35 lakh", "$1,234,567.00"), ("12345678", "₹1.23 crore", "$12,345,678.00"), ("-12345678901234", "-₹12,34,567.89 crore", "-$12,345,678,901,234.00"),
    ],
)
def test_text(spark, amount, inr, usd):
    row = spark.range(1).select(money.inr_text(F.lit(Decimal(amount))).alias("i"), money.usd_text(F.lit(Decimal(amount))).alias("u")).first()
    assert (row["i"], row["u"]) == (inr, usd)


def test_both_and_null(spark):
    row = spark.range(1).select(money.usd_with_inr(F.lit(Decimal(100)), F.lit(Decimal(85)), F.lit(date(2026, 1, 2))).alias("b"), money.inr_text(F.lit(None).cast("decimal(10,2)")).alias("n")).first()
    assert (row["b"], row["n"]) == ("$100.00 (₹8,500.00 at 85.00 INR/USD on 2026-01-02)", None)
