"""Slot arrays and their column groups against a plain pivot."""

from pyspark.sql import functions as F

from cohortloom.functions.distributed import work_path
from cohortloom.operators import wide
from cohortloom.operators.windows import to_wide

LONG = "person_id long, feature_key string, value double"


def test_groups_equal_a_pivot(spark):
    rows = [(p, f"k{f:02d}", float(1 + p * f % 5)) for p in range(20) for f in range(23)
            if (p * 7 + f * 3) % 4 == 0 and p != 3]
    rows += [(0, "k00", 9.0), (0, "k00", 2.0), (1, None, 4.0), (2, "k05", None), (99, "k01", 1.0)]
    long = spark.createDataFrame(rows, LONG)
    members = spark.range(20).select(F.col("id").alias("person_id"), (F.col("id") % 3).alias("fold"))
    slots = wide.slot_table(long)
    assert [tuple(r) for r in slots.orderBy("slot").collect()] == [(i, f"k{i:02d}") for i in range(23)]
    for width in (1, 5, 23, 1000):
        path = work_path(spark, "wide")
        wide.save_wide(wide.slot_arrays(members, long, slots, width), path)
        got = members
        for group in range(-(-23 // width)):
            columns = wide.column_group(spark, path, slots, group, width)
            assert columns.count() == 20 and "slot_group=" in columns.inputFiles()[0]
            got = got.join(columns, ["person_id", "fold"])
        keys = [f"k{i:02d}" for i in range(23)]
        want = to_wide(long.join(members, "person_id"), ["person_id", "fold"], keys, members)
        def whole(df):
            return sorted(tuple(map(int, r)) for r in df.select("person_id", "fold", *keys).collect())
        assert whole(got) == whole(want)


def test_twelve_thousand_columns(spark):
    """Plan and shuffle don't grow with the columns: one aggregation, twelve folders."""
    n = 12_000
    long = spark.range(60_000).select(
        F.pmod(F.xxhash64("id"), F.lit(50)).alias("person_id"),
        F.lpad((F.col("id") % n).cast("string"), 5, "0").alias("feature_key"), F.lit(1.0).alias("value"))
    slots, members = wide.slot_table(long), spark.range(60).withColumnRenamed("id", "person_id")
    path = work_path(spark, "wide")
    wide.save_wide(wide.slot_arrays(members, long, slots), path)
    table = spark.read.parquet(path)
    sums = table.groupBy("slot_group").agg(
        F.count("*").alias("n"), F.min(F.size("cells")).alias("least"),
        F.sum(F.aggregate("cells", F.lit(0.0), lambda a, x: a + x)).alias("total")).collect()
    assert len(sums) == 12 and {(r.n, r.least) for r in sums} == {(60, 1000)}
    assert sum(r.total for r in sums) == long.distinct().count()
    assert len(wide.column_group(spark, path, slots, 11).columns) == 1001


def test_no_features_and_no_members(spark):
    none = spark.createDataFrame([], LONG)
    members = spark.range(3).withColumnRenamed("id", "person_id")
    assert wide.slot_arrays(members, none, wide.slot_table(none)).count() == 0
    some = spark.createDataFrame([(1, "a", 1.0)], LONG)
    assert wide.slot_arrays(members.limit(0), some, wide.slot_table(some)).count() == 0
