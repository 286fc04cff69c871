"""Two's-complement and unsigned arithmetic as column expressions; Spark's own raises on overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def wrap64(x: Column) -> Column:
    """An exact decimal taken modulo 2**64, as a signed 64-bit integer."""
    wide = F.pmod(x.cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)"))
    return F.when(wide >= F.lit("9223372036854775808").cast("decimal(38,0)"), wide - F.lit("18446744073709551616").cast("decimal(38,0)")).otherwise(wide).cast("long")


def wrapping_add(a: Column, b: Column) -> Column:
    """64-bit sum that wraps around, from sums of 32-bit halves with the carry."""
    low = a.bitwiseAND(_LOW) + b.bitwiseAND(_LOW)
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_LOW))


def wrapping_mul32(a: Column, b: Column) -> Column:
    """32-bit product that wraps around, as a long."""
    low = (a.cast("long") * b.cast("long")).bitwiseAND(_LOW)
    return low.bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)


def rotate_left(x: Column, k: int) -> Column:
    """A 64-bit rotation."""
    return F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 64 - k))


def unsigned_key(x: Column) -> Column:
    """A key that sorts 64-bit patterns as unsigned numbers."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned(x: Column) -> Column:
    """The unsigned value of a 64-bit pattern."""
    return F.when(x < 0, x.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(x.cast("decimal(20,0)"))
