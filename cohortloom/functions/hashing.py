"""Seeded pseudo-random values that any engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(key: Column, seed: int) -> Column:
    """md5 text of key and seed."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def hex_to_long(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def hash32(text: Column) -> Column:
    """First 32 bits of md5 as a non-negative long."""
    return hex_to_long(F.substring(F.md5(text), 1, 8))


def uniform_int(key: Column, seed: int, lo: int, hi: int) -> Column:
    """One draw from [lo, hi], both ends included, fixed by key and seed."""
    drawn = hex_to_long(F.substring(seeded_digest(key, seed), 1, 8))
    return (F.lit(lo) + drawn % F.lit(hi - lo + 1)).cast("int")
