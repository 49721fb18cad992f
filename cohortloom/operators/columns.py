"""Projections over column names matched by rule."""

from __future__ import annotations

import re
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop all columns whose name matches."""
    return df.select(*[F.col(c) for c in df.columns if not re.search(pattern, c)])


def mutate_matching(df: DataFrame, pattern: str, fn: Callable[[Column], Column],
                    suffix: str = "") -> DataFrame:
    """Apply one expression to all matching columns, in place or under a suffix."""
    hits = [c for c in df.columns if re.search(pattern, c)]
    return df.withColumns({c + suffix: fn(F.col(c)) for c in hits}) if hits else df


def rename_matching(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Regex-rename all matching columns, for instance to strip a prefix."""
    return df.withColumnsRenamed(
        {c: re.sub(pattern, replacement, c) for c in df.columns if re.search(pattern, c)})


def fill_zero(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Replace nulls by 0 in every column except the identifying ones."""
    return df.na.fill(0, subset=[c for c in df.columns if c not in set(keep)])
