"""Symbol strings: one character per symbol.

A word under segmentation is a string with one code point per symbol. Bytes keep their own
value as code point, the symbol made by merge ``rank`` takes code point ``256 + rank`` (the
surrogate range is skipped). A pair is a two-character string, and merging a pair everywhere
is a literal replacement of two characters by one, which Spark does from left to right and
without overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTES = 256
SURROGATES = range(0xD800, 0xE000)
SEGMENT = 512
MOST_MERGES = 0x110000 - len(SURROGATES) - BYTES  # one code point each


def symbol_char(index: int) -> str:
    """The character of symbol ``index``."""
    return chr(index if index < SURROGATES.start else index + len(SURROGATES))


def symbol_index(char: str) -> int:
    """Inverse of ``symbol_char``."""
    code = ord(char)
    return code if code < SURROGATES.start else code - len(SURROGATES)


def hex_table(merged_hex: Sequence[str] = ()) -> list[str]:
    """Byte content, in hex, of every symbol: the bytes, then the merges in rank order."""
    return [f"{b:02X}" for b in range(BYTES)] + list(merged_hex)


def symbol_hex(char: Column, table: Sequence[str]) -> Column:
    """Byte content of one symbol character; ``table`` becomes a constant array of the plan."""
    code = F.ascii(char)
    position = F.when(code < SURROGATES.start, code).otherwise(code - len(SURROGATES))
    return F.element_at(F.split(F.lit(",".join(table)), ","), position + 1)


def spelled(symbols: Column, table: Sequence[str], delimiter: str = " ") -> Column:
    """The symbols of a word in hex, joined by a delimiter."""
    return F.array_join(F.transform(F.split(symbols, ""), lambda c: symbol_hex(c, table)), delimiter)


def merged(symbols: Column, pair: str, into: str) -> Column:
    """Merge one pair everywhere in a word."""
    return F.replace(symbols, F.lit(pair), F.lit(into))


def pair_rows(words: DataFrame, weight: str, *keep: str) -> DataFrame:
    """One ``(pair, weight)`` row, with the kept columns, per two neighbouring symbols, overlapping ones included.

    Long words are first cut into segments that overlap by one symbol, because reaching into a
    string costs its length; the pairs are the same and every word stays linear.
    """
    segments = words.filter(F.length("syms") > 1).select(
        weight,
        *keep,
        "syms",
        F.explode(F.sequence(F.lit(0), F.floor((F.length("syms") - 2) / SEGMENT).cast("int"))).alias("seg"),
    ).select(weight, *keep, F.substring("syms", F.col("seg") * SEGMENT + 1, F.lit(SEGMENT + 1)).alias("part"))
    return segments.select(
        weight, *keep, "part", F.explode(F.sequence(F.lit(1), F.length("part") - 1)).alias("i")
    ).select(F.substring("part", F.col("i"), F.lit(2)).alias("pair"), weight, *keep)
