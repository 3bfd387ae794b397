"""Expressions on vector columns and on scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normalisation epsilon, loss floor, rotation base, tolerance factors.
RMS_EPSILON = 1e-6
LOSS_FLOOR = 1e-8
ROTARY_BASE = 10000.0
EPSILON_DOUBLE, EPSILON_SINGLE = 1e-15, 1e-7


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def same_size(a: Column, b: Column, value: Column) -> Column:
    """``value`` where both vectors have one length, NULL where one is NULL; other lengths fail."""
    unequal = F.raise_error(F.concat(F.lit("vectors of "), F.size(a), F.lit(" and "), F.size(b), F.lit(" elements")))
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), unequal)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def residual_add(y: Column, x: Column) -> Column:
    return same_size(y, x, F.zip_with(y, x, lambda a, b: a.cast("double") + b.cast("double")))


def inverse_rms(x: Column, epsilon: float = RMS_EPSILON) -> Column:
    return 1.0 / F.sqrt(dot(x, x) / F.size(x) + epsilon)


def rmsnorm(x: Column, weight: Column, epsilon: float = RMS_EPSILON) -> Column:
    """``weight * x`` over the root mean square of ``x``."""
    pair = F.struct(x.alias("x"), inverse_rms(x, epsilon).alias("inv"))
    scaled = F.flatten(
        F.transform(
            F.array(pair),
            lambda p: F.zip_with(p["x"], weight, lambda a, w: w * (a.cast("double") * p["inv"])),
        )
    )
    return same_size(x, weight, scaled)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(x: Column) -> Column:
    """Softmax of a vector, shifted by its maximum."""
    powers = F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x).cast("double")))
    return _let(powers, lambda e: _let(total(e), lambda s: F.transform(e, lambda v: v / s)))


def softmax_gradient_product(dy: Column, y: Column) -> Column:
    """Gradient through a softmax with output ``y``."""
    return _let(dot(dy, y), lambda d: F.zip_with(dy, y, lambda g, p: (g.cast("double") - d) * p))


def rmsnorm_input_gradient(dy: Column, weight: Column, x: Column, epsilon: float = RMS_EPSILON) -> Column:
    """Gradient of ``rmsnorm`` with respect to its input."""
    weighted = F.zip_with(dy, weight, lambda g, w: g.cast("double") * w)

    def from_parts(p: Column) -> Column:
        curve = p["along"] * F.pow(p["inv"], F.lit(3.0)) / F.size(x)
        return F.zip_with(p["wg"], x, lambda g, v: g * p["inv"] - v.cast("double") * curve)

    parts = F.struct(
        weighted.alias("wg"), dot(weighted, x).alias("along"), inverse_rms(x, epsilon).alias("inv")
    )
    return _let(parts, from_parts)


def top_k(x: Column, k: int) -> Column:
    """``struct(val, idx)`` of the largest elements, the first index winning ties."""
    keyed = F.transform(x, lambda v, i: F.struct((-v.cast("double")).alias("neg"), i.alias("idx")))
    best = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(best, lambda e: F.struct((-e["neg"]).alias("val"), e["idx"].alias("idx")))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(0.0)


def swish(x: Column, beta: float = 1.0) -> Column:
    return x / (1.0 + F.exp(-beta * x))


def silu(x: Column) -> Column:
    return swish(x)


def sigmoid_prime(x: Column) -> Column:
    return sigmoid(x) * (1.0 - sigmoid(x))


def relu_prime(x: Column) -> Column:
    return F.when(x > 0, 1.0).otherwise(0.0)


def swish_prime(x: Column, beta: float = 1.0) -> Column:
    gate = sigmoid(beta * x)
    return gate + beta * x * gate * (1.0 - gate)


def silu_prime(x: Column) -> Column:
    return swish_prime(x)


def rotary(
    x: Column, pos: Column, head_dim: int, heads: int, base: float = ROTARY_BASE, inverse: bool = False
) -> Column:
    """Rotate the halves of every head by ``pos * base ** (-j / head_dim)``, or back.

    A vector that is not ``heads`` times ``head_dim`` long fails.
    """
    half, pos = head_dim // 2, -pos if inverse else pos
    rates = F.array(*[F.lit(base ** (-j / head_dim)) for j in range(half)])

    def turned(i: Column) -> Column:
        inside = F.pmod(i, F.lit(head_dim))
        j = F.pmod(inside, F.lit(half))
        first = inside < half
        angle = pos * F.get(rates, j)
        here = F.get(x, i).cast("double")
        other = F.get(x, F.when(first, i + half).otherwise(i - half)).cast("double")
        return here * F.cos(angle) + F.when(first, -other).otherwise(other) * F.sin(angle)

    out = F.transform(F.sequence(F.lit(0), F.lit(head_dim * heads - 1)), turned)
    wrong = F.raise_error(F.lit(f"a vector does not have {head_dim * heads} elements"))
    return F.when(F.size(x) == head_dim * heads, out).when(x.isNotNull(), wrong)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0)
    )


def cross_entropy(p: Column, y: Column) -> Column:
    """Loss of predicted probabilities; 0 when the target is not one-hot."""
    hit = F.array_position(y, F.lit(1.0))
    chosen = F.get(p, (hit - 1).cast("int"))
    return F.when(hit > 0, -F.log(F.greatest(chosen, F.lit(LOSS_FLOOR)))).otherwise(0.0)


def cross_entropy_logits(logits: Column, y: Column) -> Column:
    """Loss of raw scores against a target distribution."""
    terms = F.zip_with(softmax(logits), y, lambda p, t: -t * F.log(p + LOSS_FLOOR))
    return total(terms)


def close(a: Column, b: Column, significand: int, single: bool = False) -> Column:
    """Equal, or finite and within the larger of the relative and the absolute tolerance."""
    digits = min(max(significand, 1), 7 if single else 15)
    factor = EPSILON_SINGLE if single else EPSILON_DOUBLE
    slack = F.greatest(F.greatest(F.abs(a), F.abs(b)) * factor, F.lit(10.0**-digits))
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    undefined = F.isnan(a) | F.isnan(b)
    return F.when(undefined, False).when(a == b, True).when(infinite, False).otherwise(F.abs(a - b) <= slack)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def clamp_between(x: Column, a: Column, b: Column) -> Column:
    """Clamp with the bounds in either order."""
    return clamp(x, F.least(a, b), F.greatest(a, b))


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2
