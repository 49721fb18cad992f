"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paste(*cols, sep: str = ", ") -> Column:
    """Join values as text; nulls are skipped."""
    return F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str)
                              else c.cast("string") for c in cols])


def extract_or_null(col: Column, pattern: str, group: int = 0) -> Column:
    """Regex group, null when the pattern does not match."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def sentence_case(col: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(col, 1, 1)),
                    F.lower(col.substr(F.lit(2), F.length(col))))


def vocabulary_suffix(description: str = "description") -> Column:
    """The word in parentheses at the end of a description."""
    return extract_or_null(F.col(description), r"\((\w+)\)\s*$", 1)
