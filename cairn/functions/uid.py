"""Identifiers of 128 bits as decimal text, which no number type holds: two halves put together by their digits."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits, and those with their two highest bits as a UUID's variant wants them.
HEX, VARIANT = "0123456789abcdef", "89ab89ab89ab89ab"


def version4(digest: Column) -> Column:
    """The first 32 hexadecimal digits of a digest with the marks of a version-4 UUID."""
    return F.concat(F.substring(digest, 1, 12), F.lit("4"), F.substring(digest, 14, 3), F.translate(F.substring(digest, 17, 1), HEX, VARIANT), F.substring(digest, 18, 15))


def decimal_of(hexadecimal: Column) -> Column:
    """The decimal digits of 32 hexadecimal ones. With h = a * 10^10 + b for the upper half, a * 2^64 and
    b * 2^64 + lower both fit a decimal of 38 digits, and their sum is taken digit group by digit group
    (as text: the division of wide decimals rounds)."""
    half = lambda at: F.conv(F.substring(hexadecimal, at, 16), 16, 10).cast("decimal(20,0)")
    wide = F.lit(Decimal(1 << 64))
    upper, lower = half(1), half(17)
    split = F.lpad(upper.cast("string"), 20, "0")
    a, b = (F.substring(split, at, 10).cast("decimal(10,0)") for at in (1, 11))
    low = (b * wide + lower).cast("decimal(38,0)")
    digits = F.lpad(low.cast("string"), 38, "0")
    head = (a * wide).cast("decimal(38,0)") + F.substring(digits, 1, 28).cast("decimal(28,0)")
    return F.regexp_replace(F.concat(head.cast("string"), F.substring(digits, 29, 10)), "^0+(?=.)", "")


def remapped(value: Column) -> Column:
    """``2.25.`` and the decimal of a version-4 UUID made of the value's hash; null stays null."""
    return F.concat(F.lit("2.25."), decimal_of(version4(F.sha2(value, 256))))
