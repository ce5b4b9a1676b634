"""Decimal rounding of doubles on their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0  # 2^27 + 1 halves a double into two exact parts


def round_exact(c: Column, digits: int) -> Column:
    """Half-to-even rounding of the exact value, as Python's ``round`` does.

    ``bround`` works on the shortest decimal text and so treats 0.545 as a tie,
    although the double lies above it. Here the double is split into two parts
    whose products with 10^digits are exact, which decides every near-tie.
    Exact up to magnitudes of about 10^6 and six digits. A value of 2^52 or
    more has no decimals and is returned as it is, as are infinities and NaN.
    """
    power = float(10**digits)
    big = c * _SPLIT
    high = big - (big - c)
    low = c - high
    floor = F.floor(F.when(F.abs(c) < float(1 << 52), c) * power).cast("double")
    excess = (high * power - (floor + 0.5)) + low * power
    up = (excess > 0) | ((excess == 0) & (floor % 2 != 0))
    whole = F.isnan(c) | (F.abs(c) >= float(1 << 52))
    return F.when(whole, c).when(c.isNotNull(), (floor + F.when(up, 1.0).otherwise(0.0)) / power)
