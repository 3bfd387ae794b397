"""Reduced-precision number formats for vector columns.

A scalar format is described by its exponent and mantissa widths. Encoding truncates; the code of
a number is the integer with the format's bit pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivec.functions.arrays import dense, ragged, rowwise

F32_MANTISSA, F32_BIAS, F32_TOP, F32_QUIET = 23, 127, 255, 0x400000


@dataclass(frozen=True)
class Scalar:
    """A sign bit, ``exponent`` bits and ``mantissa`` bits."""

    exponent: int
    mantissa: int
    nan_mantissa: int  # mantissa that a NaN encodes to
    overflow_keeps_mantissa: bool  # whether too large numbers keep their mantissa or become infinite
    bytes: int

    @property
    def top(self) -> int:
        return (1 << self.exponent) - 1

    @property
    def bias(self) -> int:
        return self.top >> 1

    def encode(self, values: np.ndarray) -> np.ndarray:
        bits = np.ascontiguousarray(values, dtype=np.float32).view(np.uint32).astype(np.int64)
        sign, exponent, fraction = bits >> 31, (bits >> 23) & F32_TOP, bits & 0x7FFFFF
        short = fraction >> (F32_MANTISSA - self.mantissa)
        shifted = exponent - F32_BIAS + self.bias
        if not self.overflow_keeps_mantissa:
            short = np.where(shifted > self.top, 0, short)
        shifted = np.where(exponent == 0, 0, np.clip(shifted, 0, self.top))
        special = exponent == F32_TOP
        short = np.where(special, np.where(fraction == 0, 0, self.nan_mantissa), short)
        shifted = np.where(special, self.top, shifted)
        return (sign << (self.exponent + self.mantissa)) | (shifted << self.mantissa) | short

    def decode(self, codes: np.ndarray) -> np.ndarray:
        codes = np.asarray(codes, dtype=np.int64)
        sign = (codes >> (self.exponent + self.mantissa)) & 1
        exponent, short = (codes >> self.mantissa) & self.top, codes & ((1 << self.mantissa) - 1)
        fraction = short << (F32_MANTISSA - self.mantissa)
        shifted = np.where(exponent == 0, 0, exponent - self.bias + F32_BIAS)
        special = exponent == self.top
        shifted = np.where(special, F32_TOP, shifted)
        fraction = np.where(special, np.where(short == 0, 0, F32_QUIET), fraction)
        return ((sign << 31) | (shifted << F32_MANTISSA) | fraction).astype(np.uint32).view(np.float32)


# The formats.
FORMATS = {
    "e8m23": Scalar(8, 23, F32_QUIET, True, 4),
    "e5m10": Scalar(5, 10, 0x200, True, 2),
    "e8m7": Scalar(8, 7, 0x40, True, 2),
    "e4m3": Scalar(4, 3, 0x7, False, 1),
}
CODE_TYPES = {1: ("tinyint", np.int8), 2: ("smallint", np.int16), 4: ("int", np.int32)}
Q8_BLOCK, Q8_MAX, Q8_LOW, Q8_HIGH, Q8_SHIFT = 8, 127, -7, 8, 7


def _scalar(name: str) -> Scalar:
    if name not in FORMATS:
        raise ValueError(f"{name} is not a scalar format")
    return FORMATS[name]


def encode_scalar(name: str) -> Callable[[Column], Column]:
    """Vector column to codes as bit patterns in the narrowest integer: tinyint, smallint or int."""
    fmt = _scalar(name)
    kind, code = CODE_TYPES[fmt.bytes]

    def apply(vectors: pa.Array) -> pa.Array:
        matrix, missing = dense(vectors)
        codes = fmt.encode(matrix) if matrix.size else matrix
        return ragged(codes.astype(np.int64).astype(code), missing, pa.from_numpy_dtype(code))

    return F.arrow_udf(apply, f"array<{kind}>")


def unsigned(code: Column, name: str) -> Column:
    """A stored code as the unsigned integer of its bit pattern."""
    return F.pmod(code.cast("bigint"), F.lit(1 << (8 * _scalar(name).bytes)))


def decode_scalar(name: str) -> Callable[[Column], Column]:
    """Codes back to a float vector column."""
    fmt = _scalar(name)
    return rowwise(lambda codes: fmt.decode(codes).reshape(codes.shape), "float")


def q8_matrix(values: np.ndarray, block: int = Q8_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Blocked 8-bit codes and shared exponents of each row.

    The exponent comes from the largest number of the block; NaN has no part in it and takes code 0,
    an infinity takes the largest exponent and the largest code of its sign.
    """
    rows, width = values.shape
    if width == 0 or width % block:
        raise ValueError(f"{width} elements are not a positive multiple of the block {block}")
    blocks = values.astype(np.float64).reshape(rows, width // block, block)
    largest = np.fmax.reduce(np.abs(blocks), axis=2, initial=0.0)
    exponent = np.where(np.isinf(largest), Q8_HIGH, np.frexp(largest)[1] - 1 - Q8_SHIFT)
    shared = np.where(largest == 0, 0, np.clip(exponent, Q8_LOW, Q8_HIGH))
    scaled = np.rint(blocks / np.exp2(shared)[:, :, None])
    codes = np.nan_to_num(np.clip(scaled, -Q8_MAX, Q8_MAX), nan=0.0)
    return codes.reshape(rows, width).astype(np.int8), shared.astype(np.int8)


def encode_q8(block: int = Q8_BLOCK) -> Callable[[Column], Column]:
    """Vector column to ``struct<q: array<tinyint>, w: array<tinyint>>``."""

    def apply(vectors: pa.Array) -> pa.Array:
        matrix, missing = dense(vectors)
        codes, shared = q8_matrix(matrix, block) if matrix.size else (matrix, matrix)
        parts = [ragged(codes, missing, pa.int8()), ragged(shared, missing, pa.int8())]
        return pa.StructArray.from_arrays(parts, ["q", "w"], mask=pa.array(missing))

    return F.arrow_udf(apply, "struct<q:array<tinyint>,w:array<tinyint>>")


def q8_values(codes: np.ndarray, shared: np.ndarray, block: int = Q8_BLOCK) -> np.ndarray:
    """``q * 2 ** w`` with the exponent of each element's block."""
    return (codes * np.exp2(np.repeat(shared.astype(np.float64), block, axis=1))).astype(np.float32)


def decode_q8(block: int = Q8_BLOCK) -> Callable[[Column], Column]:
    """Codes back to a float vector column."""

    def apply(coded: pa.Array) -> pa.Array:
        codes, missing = dense(coded.field("q"))
        shared, _ = dense(coded.field("w"))
        values = q8_values(codes, shared, block) if codes.size else codes
        return ragged(values, missing, pa.float32())

    return F.arrow_udf(apply, "array<float>")


def round_trip(name: str, values: np.ndarray) -> np.ndarray:
    """A matrix encoded and decoded again."""
    if name == "q8":
        return q8_values(*q8_matrix(values))
    fmt = _scalar(name)
    return fmt.decode(fmt.encode(values)).reshape(values.shape)


def audit(names: tuple[str, ...]) -> Callable[[Column], Column]:
    """Per vector and format: largest and summed absolute round-trip error and finite elements."""

    def apply(vectors: pa.Array) -> pa.Array:
        matrix, missing = dense(vectors)
        fields = {"format": [], "worst": [], "total": [], "n": []}
        for name in names if matrix.size else ():
            with np.errstate(invalid="ignore"):
                gap = np.abs(matrix.astype(np.float64) - round_trip(name, matrix))
            finite = np.isfinite(gap)
            gap = np.where(finite, gap, 0.0)
            fields["format"].append(np.full(len(matrix), name))
            fields["worst"].append(gap.max(axis=1))
            fields["total"].append(gap.sum(axis=1))
            fields["n"].append(finite.sum(axis=1))
        flat = [np.stack(f, axis=1).ravel() if f else np.empty(0) for f in fields.values()]
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64()]
        rows = pa.StructArray.from_arrays([pa.array(f, k) for f, k in zip(flat, kinds)], list(fields))
        ends = np.concatenate([[0], np.cumsum(np.where(missing, 0, len(names)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), rows, mask=pa.array(missing))

    return F.arrow_udf(apply, "array<struct<format:string,worst:double,total:double,n:bigint>>")
