"""Time-window features: long form first, wide form for closed column sets.

Long rows are (ids, feature_key, value).  Wide tables need the list of their columns.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import DOMAINS, UTIL_LOCATIONS, WINDOWS, Domain, PhenotypeConfig, Window
from cohortloom.functions.dates import strictly_between_days, window_label
from cohortloom.operators.events import guarded_feature_days

IDS = ("person_id", "index_date", "observation_type", "pasc_flag")
COHORT_IDS = ("person_id", "index_date", "pasc_flag")


def assign_window(events: DataFrame, event_col: str, index_col: str = "index_date",
                  windows: Sequence[Window] = WINDOWS, name: str = "window") -> DataFrame:
    """Label the window and drop events past the last one or without a date."""
    return (events.withColumn(name, window_label(event_col, index_col, windows))
            .filter(F.col(name).isNotNull()))


def _bucketed(events: DataFrame, event_col: str, split_dates: bool, days_min: int,
              days_max: int, windows: Sequence[Window]) -> DataFrame:
    if split_dates:
        return assign_window(events, event_col, windows=windows)
    return events.filter(strictly_between_days(event_col, "index_date", days_min, days_max))


def day_counts(events: DataFrame, event_col: str, feature: Sequence[str], key: Column,
               split_dates: bool = True, days_min: int = -28, days_max: int = 180,
               windows: Sequence[Window] = WINDOWS, ids: Sequence[str] = IDS) -> DataFrame:
    """Distinct event days per person and feature (and window)."""
    group = [*ids, *feature] + (["window"] if split_dates else [])
    return (_bucketed(events, event_col, split_dates, days_min, days_max, windows)
            .groupBy(*group).agg(F.countDistinct(event_col).alias("value"))
            .select(*ids, key.alias("feature_key"), "value"))


def presence_flags(events: DataFrame, event_col: str, feature_col: str,
                   split_dates: bool = True, days_min: int = -28, days_max: int = 180,
                   windows: Sequence[Window] = WINDOWS, ids: Sequence[str] = IDS) -> DataFrame:
    """1 for every person and feature (and window) with an event; zeros are implied.

    Presence needs no day count: distinct rows combine on the map side.
    """
    parts = ["window", feature_col] if split_dates else [feature_col]
    key = F.concat_ws("_", *[F.col(c).cast("string") for c in parts])
    return (_bucketed(events, event_col, split_dates, days_min, days_max, windows)
            .select(*ids, key.alias("feature_key")).distinct()
            .withColumn("value", F.lit(1).cast("long")))


def to_wide(long: DataFrame, ids: Sequence[str], keys: Sequence[str],
            cohort: DataFrame | None = None) -> DataFrame:
    """Turn feature keys into columns, absent ones 0.

    With a cohort, members without any row get zeros: their ids are added as
    rows without a key, so one shuffle does the outer join and the pivot.
    """
    keys = list(keys)
    rows = long.select(*ids, "feature_key", F.col("value").cast("long").alias("value"))
    if cohort is not None:
        empty = cohort.select(*ids, F.lit(None).cast("string").alias("feature_key"),
                              F.lit(None).cast("long").alias("value"))
        rows = rows.unionByName(empty)
    if not keys:
        return rows.select(*ids).distinct()
    return rows.groupBy(*ids).pivot("feature_key", keys).agg(F.max("value")).na.fill(0, keys)


def util_keys(split_dates: bool = True, windows: Sequence[Window] = WINDOWS) -> list[str]:
    """All location (and window) columns."""
    if not split_dates:
        return list(UTIL_LOCATIONS)
    return [f"{loc}_{w.label}" for loc in UTIL_LOCATIONS for w in windows]


def util_long(events: DataFrame, split_dates: bool = True, days_min: int = -28,
              days_max: int = 180, windows: Sequence[Window] = WINDOWS,
              ids: Sequence[str] = IDS) -> DataFrame:
    """Distinct visit days per location (and window)."""
    key = F.concat_ws("_", "util_loc", "window") if split_dates else F.col("util_loc")
    return day_counts(events, "util_start_date", ["util_loc"], key, split_dates,
                      days_min, days_max, windows, ids)


def partition_dates_and_pivot_wide_util(
        events: DataFrame, split_dates: bool = True, days_min: int = -28, days_max: int = 180,
        windows: Sequence[Window] = WINDOWS) -> DataFrame:
    """Visit-day counts, one column per location (and window)."""
    return to_wide(util_long(events, split_dates, days_min, days_max, windows), IDS,
                   util_keys(split_dates, windows))


def partition_dates_and_pivot_wide_features(
        events: DataFrame, keys: Sequence[str], feature_col: str = "ancestor_concept_id",
        split_dates: bool = True, days_min: int = -28, days_max: int = 180,
        windows: Sequence[Window] = WINDOWS) -> DataFrame:
    """0/1 columns per feature (and window) for persons with any event."""
    long = presence_flags(events, "visit_start_date", feature_col, split_dates,
                          days_min, days_max, windows)
    return to_wide(long, IDS, keys)


def lab_count_long(events: DataFrame, split_dates: bool = True, days_min: int = -28,
                   days_max: int = 180, windows: Sequence[Window] = WINDOWS,
                   ids: Sequence[str] = IDS) -> DataFrame:
    """Sum over labs of their distinct days.

    Equal to the number of distinct (lab, day) pairs; nulls in the lab id count
    as one lab, hence distinct rows rather than a distinct count of structs.
    """
    group = [*ids] + (["window"] if split_dates else [])
    key = F.col("window") if split_dates else F.lit("n_labs")
    return (_bucketed(events, "lab_start_date", split_dates, days_min, days_max, windows)
            .select(*group, "measurement_concept_id", "lab_start_date").distinct()
            .groupBy(*group).agg(F.count("*").alias("value"))
            .select(*ids, key.alias("feature_key"), "value"))


def lab_count_keys(split_dates: bool = True, windows: Sequence[Window] = WINDOWS) -> list[str]:
    return [w.label for w in windows] if split_dates else ["n_labs"]


def partition_dates_and_pivot_wide_lab_cts(
        events: DataFrame, split_dates: bool = True, days_min: int = -28, days_max: int = 180,
        windows: Sequence[Window] = WINDOWS) -> DataFrame:
    """Lab counts, one column per window or a single ``n_labs``."""
    return to_wide(lab_count_long(events, split_dates, days_min, days_max, windows), IDS,
                   lab_count_keys(split_dates, windows))


def feature_long(cohort: DataFrame, domain: Domain | str, features: DataFrame,
                 events: DataFrame, visits: DataFrame, observations: DataFrame,
                 days_delta: int = -28, split_dates: bool = True, days_min: int = -28,
                 days_max: int = 180, cfg: PhenotypeConfig = PhenotypeConfig(),
                 ids: Sequence[str] = COHORT_IDS) -> DataFrame:
    """Leak-guarded presence features of one domain, or of all stacked, in long form."""
    domain = DOMAINS[domain] if isinstance(domain, str) else domain
    ids = (*ids, "domain") if domain.members else ids
    needed = dict.fromkeys([c for c in ids if c != "domain"] + ["index_date"])
    days = guarded_feature_days(cohort.select(*needed), features, events, visits, observations,
                                domain, days_delta, cfg)
    return presence_flags(days, "visit_start_date", "ancestor_concept_id", split_dates,
                          days_min, days_max, cfg.windows, ids)


def make_feature_tbl(cohort: DataFrame, domain: Domain | str, features: DataFrame,
                     events: DataFrame, visits: DataFrame, observations: DataFrame,
                     keys: Sequence[str], days_delta: int = -28, split_dates: bool = True,
                     days_min: int = -28, days_max: int = 180,
                     cfg: PhenotypeConfig = PhenotypeConfig()) -> DataFrame:
    """Wide 0/1 features of one domain for every cohort member."""
    long = feature_long(cohort, domain, features, events, visits, observations,
                        days_delta, split_dates, days_min, days_max, cfg)
    return to_wide(long, COHORT_IDS, keys, cohort)


def make_util_tbl(cohort: DataFrame, util_events: DataFrame, split_dates: bool = True,
                  days_min: int = -28, days_max: int = 180,
                  windows: Sequence[Window] = WINDOWS) -> DataFrame:
    """Wide utilisation counts for every cohort member."""
    long = util_long(util_events, split_dates, days_min, days_max, windows, COHORT_IDS)
    return to_wide(long, COHORT_IDS, util_keys(split_dates, windows), cohort)


def make_lab_count_tbl(cohort: DataFrame, lab_events: DataFrame, split_dates: bool = True,
                       days_min: int = -28, days_max: int = 180,
                       windows: Sequence[Window] = WINDOWS) -> DataFrame:
    """Wide lab counts for every cohort member."""
    long = lab_count_long(lab_events, split_dates, days_min, days_max, windows, COHORT_IDS)
    return to_wide(long, COHORT_IDS, lab_count_keys(split_dates, windows), cohort)
