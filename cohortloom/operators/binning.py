"""A binned feature matrix: every value as one of at most 256 bins of its feature.

Cut points are distributed quantiles of the stored values, with zero among them, so that flags
have two bins.  They use no outcome and are found once on all rows; the matrix is stored once,
with the fold as a column, and read by the models of all folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.distributed import row_numbers, stored, union_all

MAX_BINS = 256
ACCURACY = 10_000


def _entries(long: DataFrame) -> DataFrame:
    """Rows that hold a value: nulls, NaN and zeros are what an absent row is."""
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0))


def feature_slots(long: DataFrame, max_bins: int = MAX_BINS) -> DataFrame:
    """(slot, feature_key, cuts, zero): features numbered from 0 in the order of their keys.

    A value's bin is the number of cuts below it; ``zero`` is the bin of an absent value.
    Numbers come from a range sort and partition offsets, so no key list passes the driver.
    """
    share = [i / (max_bins - 2) for i in range(max_bins - 1)]
    cuts = _entries(long).groupBy("feature_key").agg(
        F.percentile_approx(F.col("value").cast("double"), share, ACCURACY).alias("q"))
    cuts = cuts.select("feature_key", F.array_sort(F.array_distinct(
        F.concat("q", F.array(F.lit(0.0))))).alias("cuts"))
    zero = F.size(F.filter("cuts", lambda c: c < 0))
    return stored(row_numbers(cuts, ["feature_key"], "slot").select(
        (F.col("slot") - 1).cast("int").alias("slot"), "feature_key", "cuts", zero.alias("zero")))


def binned_rows(members: DataFrame, long: DataFrame, slots: DataFrame) -> DataFrame:
    """The columns of ``members`` with ``slots`` and ``bins``, arrays of what is not zero's bin.

    One row for each member, by ``person_id``; rows of features without a slot and of other
    persons are left out.  Of rows that repeat a person and feature the largest bin stays.
    """
    below = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    entry = F.struct("slot", F.least(below, F.size("cuts") - 1).alias("bin")).alias("e")
    rows = _entries(long).join(slots, "feature_key").select("person_id", "zero", entry)
    rows = rows.filter("e.bin <> zero").drop("zero")
    carried = [c for c in members.columns if c != "person_id"]
    grouped = union_all([members.withColumn("_member", F.lit(True)), rows], allow_missing=True
                        ).groupBy("person_id").agg(
        *[F.max(c).alias(c) for c in carried], F.max("_member").alias("_member"),
        F.sort_array(F.collect_list("e")).alias("e"))
    last = F.filter("e", lambda x, i: F.coalesce(
        F.get(F.col("e"), i + 1)["slot"] != x["slot"], F.lit(True)))
    return (grouped.filter("_member").withColumn("e", last)
            .select("person_id", *carried, F.col("e.slot").alias("slots"), F.col("e.bin").alias("bins")))


def presence(long: DataFrame, slots: DataFrame, folds: int) -> DataFrame:
    """(slot, present): an array by fold of whether both parts of the fold hold the feature.

    ``long`` carries ``fold``, the fold in which a person is tested.
    """
    held = _entries(long).groupBy("feature_key").agg(F.collect_set("fold").alias("held"))
    both = [F.array_contains("held", k) & (F.size("held") > 1) for k in range(1, folds + 1)]
    return slots.join(held, "feature_key").select("slot", F.array(*both).alias("present"))
