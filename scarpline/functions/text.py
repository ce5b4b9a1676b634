"""Missing-value, number and date handling of text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The text tokens a CSV reader treats as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Accepted date shapes. Year-first and day-month-year with
# dashes; with slashes month-first is tried before day-first.
YEAR_FIRST = r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"
YEAR_LAST = r"^\d{1,2}([-/])\d{1,2}\1\d{4}$"

# Every character that counts as whitespace when text is stripped.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Remove all leading and trailing whitespace."""
    return F.trim(c, F.lit(WHITESPACE))


def squash(c: Column) -> Column:
    """Strip and collapse every inner run of whitespace to one space."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def is_missing(c: Column) -> Column:
    """True for NULL and for text made of whitespace only; never NULL."""
    return F.coalesce(strip(c.cast("string")) == "", F.lit(True))


def null_token(c: Column) -> Column:
    """Turn the missing-value tokens of CSV text into NULL."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def to_number(c: Column) -> Column:
    """Parse text as a double; NULL when it is not a plain decimal number.

    The cast alone would also read Java literals such as 1.5d or 0x1p3.
    """
    text = c.cast("string")
    literal = text.rlike("(?i)^[^i]*[dfx]")  # "inf" has its i first
    number = strip(text).try_cast("double")
    return F.when(~literal, F.nanvl(number, F.lit(None).cast("double")))


def is_bad_number(c: Column) -> Column:
    """Present, yet not a number."""
    return ~is_missing(c) & to_number(c).isNull()


def outside(c: Column, low: float | None, high: float | None) -> Column:
    """True when a present value lies outside the closed range; never NULL."""
    checks = []
    if low is not None:
        checks.append(c < F.lit(float(low)))
    if high is not None:
        checks.append(c > F.lit(float(high)))
    if not checks:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, checks), F.lit(False))


def to_iso_date(c: Column) -> Column:
    """The strict year-month-day reading of a text column."""
    text = strip(c)
    return F.when(text.rlike(YEAR_FIRST) & ~F.contains(text, F.lit("/")), text.try_cast("date"))


def to_any_date(c: Column) -> Column:
    """The first accepted layout that reads the text."""
    text = strip(c)
    dashed = F.translate(text, "/", "-")
    part = lambda i: F.split_part(dashed, F.lit("-"), F.lit(i))
    month_first = F.concat_ws("-", part(3), part(1), part(2)).try_cast("date")
    day_first = F.concat_ws("-", part(3), part(2), part(1)).try_cast("date")
    year_last = F.when(F.contains(text, F.lit("-")), day_first).otherwise(F.coalesce(month_first, day_first))
    return F.when(text.rlike(YEAR_FIRST), dashed.try_cast("date")).when(text.rlike(YEAR_LAST), year_last)


def count_true(c: Column) -> Column:
    """Number of rows where the flag holds (0 for an empty table)."""
    return F.count_if(c)
