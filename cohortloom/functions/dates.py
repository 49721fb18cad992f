"""Date expressions."""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.config import WINDOWS, Window


def days_after(event: str, index: str) -> Column:
    """Signed days from index date to event date."""
    return F.datediff(F.col(event), F.col(index))


def since_index(event: str, index: str, days: int) -> Column:
    """Event on or after index + days."""
    return F.col(event) >= F.date_add(F.col(index), days)


def since_index_months(event: str, index: str, months: int) -> Column:
    """Event on or after index + calendar months (clamped at month end)."""
    return F.col(event) >= F.add_months(F.col(index), months)


def in_follow_up(event: str, index: str, days: int, months: int) -> Column:
    """index + days <= event < index + months."""
    return since_index(event, index, days) & (
        F.col(event) < F.add_months(F.col(index), months))


def strictly_between_days(event: str, index: str, lo: int, hi: int) -> Column:
    """index + lo < event < index + hi."""
    return (F.col(event) > F.date_add(F.col(index), lo)) & (
        F.col(event) < F.date_add(F.col(index), hi))


def follow_up_possible(index: str, max_date: date, months: int) -> Column:
    """Index early enough for the given follow-up before max_date."""
    return F.col(index) < F.add_months(F.lit(max_date), -months)


def age_in_years(birth: str, at: str) -> Column:
    """Whole years of 365.25 days."""
    return F.floor(F.datediff(F.col(at), F.col(birth)) / F.lit(365.25)).cast("int")


def window_label(event: str, index: str,
                 windows: Sequence[Window] = WINDOWS) -> Column:
    """Label of the first window the event falls in; null when past the last one."""
    gap = days_after(event, index)
    label = None
    for w in windows:
        inside = gap < w.hi if w.lo is None else (gap >= w.lo) & (gap < w.hi)
        label = F.when(inside, w.label) if label is None else label.when(inside, w.label)
    return label


def month_period(index: str, periods: Sequence[tuple[str, str, str]]) -> Column:
    """Label of the month range that holds the date; null when none does."""
    month = F.date_format(F.col(index), "yyyy-MM")
    label = None
    for name, first, last in periods:
        hit = month.between(first, last)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label
