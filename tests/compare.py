"""Compare a Spark result with a SQL result as multisets of rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, Decimal):
        return ("decimal", value)
    if isinstance(value, float):
        return ("float", round(value, 9) + 0.0)
    if isinstance(value, dt.datetime):
        return ("datetime", value.isoformat())
    if isinstance(value, dt.date):
        return ("date", value.isoformat())
    return value


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            Counter(tuple(normal(r[i]) for i in order) for r in rows))


def difference(spark_df, cursor):
    """None when equal, else a short description."""
    rows = spark_df.collect()
    got_columns, got = multiset(spark_df.columns, rows)
    names = [d[0] for d in cursor.description]
    want_columns, want = multiset(names, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if not rows:
        return "empty result"
    if got != want:
        extra, missing = got - want, want - got
        return (f"rows {sum(got.values())} != {sum(want.values())}; "
                f"extra {list(extra.items())[:2]} missing {list(missing.items())[:2]}")
    return None
