"""Seeded draws as hashes of keys: the same on any partitioning, and after a lost task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
SCALE = float(16 ** HEX_DIGITS)


def hashed(*parts) -> Column:
    """First 13 hex digits of the md5 of the joined parts, as a non-negative bigint."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(text, 1, HEX_DIGITS), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform on (0, 1), never exactly 0 or 1."""
    return (hashed(*parts).cast("double") + 0.5) / SCALE
