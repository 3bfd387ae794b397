"""Unsigned 64-bit hashes as expressions.

A hash is kept as two 32-bit halves in bigints, so no step can overflow and the arithmetic stays
inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# djb2 start and factor, Knuth's multiplier.
DJB2_START, DJB2_FACTOR = 5381, 33
KNUTH = 2654435761
HALF = 0xFFFFFFFF


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(HALF))


def hash_value(halves: Column) -> Column:
    """The hash as ``decimal(20, 0)``."""
    return (
        halves["hi"].cast("decimal(20,0)") * F.lit(HALF + 1).cast("decimal(20,0)") + halves["lo"]
    ).cast("decimal(20,0)")


def bucket_of(halves: Column, size: int) -> Column:
    """Hash modulo a bucket count."""
    if not 0 < size < 1 << 31:
        raise ValueError("bucket count out of range")
    return (F.pmod(halves["hi"], F.lit(size)) * ((HALF + 1) % size) + halves["lo"]) % size


def djb2(text: Column) -> Column:
    """djb2 over the signed bytes of a string."""
    byte = F.regexp_extract_all(F.hex(text), F.lit("(..)"), 1)
    start = F.struct(F.lit(0).cast("bigint").alias("hi"), F.lit(DJB2_START).cast("bigint").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        unsigned = F.conv(b, 16, 10).cast("bigint")
        signed = unsigned - F.when(unsigned > 127, 256).otherwise(0)
        low = h["lo"] * DJB2_FACTOR + signed
        high = h["hi"] * DJB2_FACTOR + F.shiftright(low, 32)
        return F.struct(_low(high).alias("hi"), _low(low).alias("lo"))

    return F.aggregate(byte, start, step)


def knuth32(key: Column) -> Column:
    """Knuth's multiplicative hash of a 32-bit key, wrapped to 32 bits."""
    return _low(key.cast("int").cast("bigint") * KNUTH)


def knuth64(key: Column) -> Column:
    """Knuth's multiplicative hash of a 64-bit key, wrapped to 64 bits."""
    k = key.cast("bigint")
    upper = _low(k).bitwiseAND(F.lit(0xFFFF0000))
    p1 = F.shiftright(upper, 16) * KNUTH
    p0 = k.bitwiseAND(F.lit(0xFFFF)) * KNUTH
    low = F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + _low(p0)
    high = F.shiftright(p1, 16) + F.shiftright(p0, 32) + F.shiftright(low, 32)
    high = _low(high + _low(F.shiftright(k, 32) * KNUTH))
    return F.struct(high.alias("hi"), _low(low).alias("lo"))
