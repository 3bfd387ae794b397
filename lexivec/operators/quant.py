"""Quantisation of embedding tables and audits of its error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import formats as fm


def quantized(table: DataFrame, fmt: str, vec: str = "embedding", into: str = "code", block: int = fm.Q8_BLOCK) -> DataFrame:
    """Replace a vector column by its codes in the given format (a matrix is quantised row by row)."""
    encode = fm.encode_q8(block) if fmt == "q8" else fm.encode_scalar(fmt)
    return table.withColumn(into, encode(F.col(vec))).drop(vec)


def dequantized(table: DataFrame, fmt: str, code: str = "code", into: str = "vec", block: int = fm.Q8_BLOCK) -> DataFrame:
    """Codes back to float vectors."""
    decoded = fm.decode_q8(block)(F.col(code)) if fmt == "q8" else fm.decode_scalar(fmt)(F.col(code))
    return table.withColumn(into, decoded).drop(code)


def quant_error(table: DataFrame, by: str, vec: str = "embedding", fmts: tuple[str, ...] = (*fm.FORMATS, "q8")) -> DataFrame:
    """Largest and mean absolute round-trip error per format and group, over finite results.

    One scan audits all formats; each vector becomes one small row per format before the shuffle.
    (The outer form keeps the optimizer from filtering on the audit first, which would run it twice.)
    """
    audited = table.select(by, fm.audit(fmts)(F.col(vec)).alias("a")).select(by, F.inline_outer("a"))
    return audited.filter("format is not null").groupBy("format", by).agg(
        F.max("worst").alias("max_error"),
        (F.sum("total") / F.sum("n")).alias("mean_error"),
        F.sum("n").alias("n_finite"),
    )


def type_footprint(table: DataFrame, vec: str = "embedding", block: int = fm.Q8_BLOCK) -> DataFrame:
    """Bytes that a vector column takes in each format."""
    sizes = [(name, float(fmt.bytes)) for name, fmt in fm.FORMATS.items()]
    sizes += [("f32", 4.0), ("q8", 1.0 + 1.0 / block)]
    total = table.agg(F.coalesce(F.sum(F.size(vec)), F.lit(0)).cast("bigint").alias("n_elements"))
    rows = F.array(
        *[F.struct(F.lit(n).alias("format"), F.lit(b).alias("bytes_per_element")) for n, b in sizes]
    )
    return total.select("n_elements", F.inline(rows)).withColumn(
        "total_bytes", F.col("n_elements") * F.col("bytes_per_element")
    )
