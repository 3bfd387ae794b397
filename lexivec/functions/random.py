"""Reproducible random columns: a Lehmer stream with random access.

Draw ``k`` of the stream is ``multiplier ** k * seed`` modulo a prime, so every row computes its
own draw from its index and the result does not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the generator.
MULTIPLIER, MODULUS, DEFAULT_SEED = 48271, 2147483647, 123456789


def lehmer_int(k: Column, seed: int = DEFAULT_SEED) -> Column:
    """Draw ``k`` (from 1) as a bigint; a seed below 1 means the default seed."""
    x = F.lit((seed if seed > 0 else DEFAULT_SEED) % MODULUS).cast("bigint")
    power = F.pmod(k.cast("bigint"), F.lit(MODULUS - 1))
    factor = MULTIPLIER
    for bit in range(31):
        chosen = F.when(power.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(factor)).otherwise(F.lit(1))
        x = x * chosen.cast("bigint") % MODULUS
        factor = factor * factor % MODULUS
    return x


def lehmer_uniform(k: Column, seed: int = DEFAULT_SEED) -> Column:
    """Draw ``k`` as a double in (0, 1)."""
    return lehmer_int(k, seed) / F.lit(float(MODULUS))


def lehmer_uniform_single(k: Column, seed: int = DEFAULT_SEED) -> Column:
    """Draw ``k`` rounded to single precision."""
    return lehmer_uniform(k, seed).cast("float")


def xavier(k: Column, fan_out: int, fan_in: int, seed: int = DEFAULT_SEED) -> Column:
    """Uniform draw in plus or minus the square root of 6 / (fan_in + fan_out)."""
    return (2.0 * lehmer_uniform(k, seed) - 1.0) * math.sqrt(6.0 / (fan_in + fan_out))


def muller(k: Column, fan_out: int, fan_in: int, seed: int = DEFAULT_SEED) -> Column:
    """Normal draw ``k`` from draws ``2k - 1`` and ``2k``, scaled by sqrt(2 / (fan_in + fan_out))."""
    u1 = F.greatest(lehmer_uniform(2 * k - 1, seed), F.lit(1e-7))
    u2 = F.greatest(lehmer_uniform(2 * k, seed), F.lit(1e-7))
    normal = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
    return normal * math.sqrt(2.0 / (fan_in + fan_out))
