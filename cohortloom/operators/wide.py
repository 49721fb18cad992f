"""Wide tables of any width: dense arrays by group of slots, and their projection into columns.

A pivot needs one conditional aggregate for each column; with thousands of columns that plan
neither compiles nor runs.  Here features are numbered, one aggregation gathers a person's
values by group of slots, and a group's array becomes columns when it is read.  Groups are
separate folders, so a reader of some columns opens only theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.distributed import row_numbers, stored, union_all

WIDTH = 1000


def slot_table(long: DataFrame) -> DataFrame:
    """(slot, feature_key): features numbered from 0 in the order of their keys.

    Numbers come from a range sort and partition offsets; no key list passes the driver.
    """
    keys = long.select("feature_key").filter(F.col("feature_key").isNotNull()).distinct()
    return stored(row_numbers(keys, ["feature_key"], "slot")
                  .select((F.col("slot") - 1).cast("int").alias("slot"), "feature_key"))


def slot_arrays(members: DataFrame, long: DataFrame, slots: DataFrame,
                width: int = WIDTH) -> DataFrame:
    """The columns of ``members`` with ``slot_group`` and ``cells``, ``width`` values each.

    One row for each member, by ``person_id``, and group; absent and null values are 0.  Of
    rows that repeat a person and feature the largest value stays; rows of features without
    a slot and of other persons are left out.
    """
    groups = slots.agg(F.ceil((F.max("slot") + 1) / width)).first()[0] or 0
    carried = [c for c in members.columns if c != "person_id"]
    every = F.sequence(F.lit(0), F.lit(groups - 1)) if groups else F.array().cast("array<int>")
    frame = members.withColumns({"_member": F.lit(True), "slot_group": F.explode(every)})
    entry = F.struct((F.col("slot") % width).alias("at"),
                     F.col("value").cast("double").alias("value")).alias("e")
    cells = (long.filter(F.col("value").isNotNull()).join(slots, "feature_key")
             .select("person_id", F.floor(F.col("slot") / width).cast("int").alias("slot_group"), entry))
    rows = union_all([frame, cells], allow_missing=True).groupBy("person_id", "slot_group").agg(
        *[F.max(c).alias(c) for c in carried], F.max("_member").alias("_member"),
        F.sort_array(F.collect_list("e")).alias("e"))
    last = F.filter("e", lambda x, i: F.coalesce(
        F.get(F.col("e"), i + 1)["at"] != x["at"], F.lit(True)))
    rows = rows.filter("_member").withColumn("e", last)

    def zeros(n):
        return F.array_repeat(F.lit(0.0), n)

    # Each value after the zeros since the one before it, then the zeros up to the end.
    filled = F.transform("e", lambda x, i: F.concat(
        zeros(x["at"] - F.coalesce(F.get(F.col("e"), i - 1)["at"], F.lit(-1)) - 1),
        F.array(x["value"])))
    rest = zeros(width - 1 - F.coalesce(F.get(F.col("e"), F.size("e") - 1)["at"], F.lit(-1)))
    return rows.select("person_id", *carried, "slot_group",
                       F.flatten(F.concat(filled, F.array(rest))).alias("cells"))


def save_wide(arrays: DataFrame, path: str) -> None:
    """One folder for each group of slots."""
    arrays.write.partitionBy("slot_group").parquet(path)


def column_group(spark: SparkSession, path: str, slots: DataFrame, group: int,
                 width: int = WIDTH) -> DataFrame:
    """The saved columns of one group, named by their features; at most ``width`` of them."""
    names = slots.filter(F.floor(F.col("slot") / width) == group).collect()
    table = spark.read.parquet(path).filter(F.col("slot_group") == group)
    carried = [c for c in table.columns if c not in ("slot_group", "cells")]
    return table.select(*carried, *[F.get("cells", F.lit(r["slot"] % width)).alias(r["feature_key"])
                                    for r in sorted(names)])
