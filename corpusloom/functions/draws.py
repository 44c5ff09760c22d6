"""Keyed random draws: a hash of the row's key, never ``rand()``.

A retried task, another partitioning or another engine gives the same draw. Hexadecimal text of a fixed width orders like
the number it spells, so a draw is compared with a probability without being converted. Rows draw from a digest of their key;
the many tokens of a row draw from a fast 64-bit hash of the row's key plus their position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 8


def digest(*key: Column | str | int) -> Column:
    """32 hexadecimal digits drawn for the key; text and numbers are literals, columns are columns."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def threshold(p: float, digits: int = DIGITS) -> str:
    """Text that exactly the draws below ``p`` precede."""
    if p >= 1:
        return "g"
    return format(math.floor(max(p, 0.0) * 16**digits), f"0{digits}x")


def below(hexdigits: Column, p: float, at: int = 1) -> Column:
    """Whether the draw in the digits from ``at`` on (1-based) is below ``p``."""
    return F.substring(hexdigits, at, DIGITS) < F.lit(threshold(p))


def integer(hexdigits: Column, n: Column | int, at: int = 1, digits: int = 15) -> Column:
    """Whole number in ``[0, n)`` from up to 15 digits (60 bits)."""
    value = F.conv(F.substring(hexdigits, at, digits), 16, 10).cast("bigint")
    return F.pmod(value, n if isinstance(n, Column) else F.lit(n).cast("bigint"))


def row_key(*key: Column | str | int) -> Column:
    """60-bit whole number drawn for the key, to which positions are added."""
    return F.conv(F.substring(digest(*key), 1, 15), 16, 10).cast("bigint")


def position_draw(key: Column, position: Column) -> Column:
    """64 bits for one position of a row."""
    return F.xxhash64(key + position)


def low_below(bits: Column, p: float) -> Column:
    """Whether the lower 32 bits are a draw below ``p``."""
    return bits.bitwiseAND(F.lit(0xFFFFFFFF)) < F.lit(math.floor(p * 2**32))


def high_integer(bits: Column, n: int) -> Column:
    """Whole number in ``[0, n)`` from the upper 32 bits."""
    return F.pmod(F.shiftrightunsigned(bits, 32), F.lit(n).cast("bigint"))
