"""Byte-exact text expressions.

The unit of text is the byte, not the code point. Spark strings are UTF-8, so bytes are handled
through their hex view: two upper-case digits per byte, which sorts in byte order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six whitespace bytes of the C locale, and the printable range.
WHITESPACE = " \t\n\x0b\f\r"
PRINTABLE_FIRST, PRINTABLE_LAST = 0x20, 0x7E


def before_nul(text: Column) -> Column:
    """Text up to its first NUL byte."""
    return F.substring_index(text, "\0", 1)


def byte_hex(text: Column) -> Column:
    """The hex view of a string."""
    return F.hex(text)


def fields_by_whitespace(text: Column) -> Column:
    """Split on runs of whitespace bytes; the ends may leave empty fields that the caller drops.

    Splitting reads characters, so bytes that are not UTF-8 are split in their one-character-per-byte
    view, whose parts are turned back to the same bytes.
    """
    pattern = f"[{WHITESPACE}]+"
    parts = F.transform(F.split(byte_chars(before_nul(text)), pattern), from_byte_chars)
    plain = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\0"))  # nearly every text: split as it is
    return F.when(plain, F.split(text, pattern)).otherwise(parts)


def ws_tokens(text: Column) -> Column:
    """Array of maximal runs of non-whitespace bytes."""
    return F.filter(fields_by_whitespace(text), lambda w: w != "")


def delimited_fields(text: Column, delimiter: str) -> Column:
    """Split on a literal delimiter.

    Leading and inner empty fields stay, one trailing empty field is dropped, and an empty
    delimiter gives the single bytes (in hex).
    """
    if delimiter == "":
        return byte_list(text)
    fields = F.split(text, re.escape(delimiter), -1)
    return F.when(
        F.element_at(fields, -1) == "", F.slice(fields, F.lit(1), F.size(fields) - 1)
    ).otherwise(fields)


def byte_list(text: Column) -> Column:
    """Array of the bytes of a string, each as two hex digits."""
    return F.regexp_extract_all(byte_hex(text), F.lit("(..)"), 1)


def regex_matches(text: Column, pattern: str, unicode_classes: bool = True) -> Column:
    """All non-empty matches of a pattern before the first NUL, in order."""
    prefix = "(?U)" if unicode_classes else ""
    found = F.regexp_extract_all(before_nul(text), F.lit(prefix + pattern), 0)
    return F.filter(found, lambda m: m != "")


def joined(parts: Column, delimiter: str) -> Column:
    """Join the parts; NULL when there are none."""
    return F.when(F.size(parts) > 0, F.array_join(parts, delimiter))


def byte_prefix(text: Column, n: int) -> Column:
    """Hex of the first ``n`` bytes, NULL when the text is shorter."""
    return F.when(F.octet_length(text) >= n, F.substring(byte_hex(text), 1, 2 * n))


def byte_chars(text: Column) -> Column:
    """One character per byte: byte ``b`` becomes code point ``b``. Keeps byte order."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def from_byte_chars(text: Column) -> Column:
    """Inverse of ``byte_chars``, whatever the bytes."""
    return F.encode(text, "ISO-8859-1").cast("string")


def unprintable_removed(text: Column) -> Column:
    """The text without the bytes outside the base alphabet."""
    return F.regexp_replace(byte_chars(text), "[^ -~]+", "")


def path_dirname(path: Column) -> Column:
    """Part before the last slash: ``.`` without a slash, ``/`` at the root, empty for no path."""
    cut = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "")
        .when(F.instr(path, "/") == 0, ".")
        .when(cut <= 0, "/")
        .otherwise(F.substring(path, F.lit(1), cut))
    )


def path_basename(path: Column) -> Column:
    """Part after the last slash."""
    return F.coalesce(F.substring_index(path, "/", -1), F.lit(""))


def path_join(root: Column, sub: Column) -> Column:
    """Two path parts with exactly the needed slash; NULL when either is missing."""
    glue = F.when(F.endswith(root, F.lit("/")), "").otherwise("/")
    return F.when((root != "") & (sub != ""), F.concat(root, glue, sub))


def path_parts(path: Column) -> Column:
    """Components between slashes, empties dropped."""
    return F.filter(F.split(path, "/"), lambda p: p != "")
