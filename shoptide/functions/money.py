"""Exact money arithmetic in whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def amount(cents_column: Column) -> Column:
    return (cents_column.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(16,2)")


def half_even_share(part: Column, pay: Column, whole: Column) -> Column:
    """``part * pay / whole`` in cents, ties to the even cent; NULL when ``whole`` is 0.

    Ordinary amounts stay in BIGINT; a product beyond it, or a negative one, takes the DECIMAL form. Kept short: the
    compiled method of a wide row must stay below the size the JVM still optimises.
    """
    divisor = F.nullif(whole, F.lit(0))
    plain = _half_even_quotient(F.when(pay >= 0, F.try_multiply(part, pay)), divisor, whole)
    sign = F.when(pay < 0, -1).otherwise(1)
    large = F.abs(part.cast("decimal(19,0)") * pay.cast("decimal(19,0)"))
    return F.coalesce(plain, _half_even_quotient(large, divisor.cast("decimal(19,0)"), whole) * sign)


def _half_even_quotient(product: Column, divisor: Column, whole: Column) -> Column:
    """Rounds up when twice the rest exceeds the divisor, or equals it and the quotient is odd."""
    quotient = F.call_function("div", product, divisor)
    rest = (product % divisor).cast("bigint")
    return quotient + (rest > whole - rest - quotient.bitwiseAND(F.lit(1))).cast("int")
