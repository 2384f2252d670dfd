"""Stable hashes: buckets in [0, 1), nested samples, content-addressed names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(key: Column) -> Column:
    """The first eight bytes of SHA-256, big-endian, over 2**64."""
    first = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10)
    return first.cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def nested_position(index: Column) -> Column:
    """A multiplicative hash of a row index over 2**32: samples below a share are nested in those below a larger one."""
    low, high = index.bitwiseAND(F.lit(0xFFFF)), F.shiftright(index, 16).bitwiseAND(F.lit(0xFFFF))
    k = F.lit(2654435761)  # products of 16-bit halves stay inside a long
    return (low * k + (high * k).bitwiseAND(F.lit(0xFFFF)) * 65536).bitwiseAND(F.lit(0xFFFFFFFF)) / F.lit(4294967296.0)


def content_name(value: Column, length: int = 16) -> Column:
    """A hexadecimal SHA-256 prefix of 12, 16 or 64 characters."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, length)
