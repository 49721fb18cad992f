"""Global order without a single-task window, and intermediate tables.

``row_number`` over everything, or over a few huge groups, sorts all rows in a
few tasks.  Here rows are range-sorted across the cluster, written to the
reliable checkpoint folder so that their partitions are stable, numbered inside
each partition, and shifted by the partition offsets.  Only one small row per
partition is ever brought together.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PART = "_part"
POS = "_pos"
# monotonically_increasing_id keeps the row position in the low 33 bits.
_POSITION_MASK = (1 << 33) - 1
# Folders of intermediate tables, for clear_stored.
_written: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the warehouse.

    Executors share both, whatever the master.
    """
    sc = spark.sparkContext
    folder = (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
              or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder, deleted by :func:`clear_stored`."""
    path = f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared checkpoint folder.

    Unlike a checkpoint it keeps column pruning, and its file sizes let Spark
    decide on broadcasts from facts.
    """
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_stored(spark: SparkSession) -> None:
    """Delete what this process wrote under :func:`work_path`, once nothing reads it."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sorted_partitions(df: DataFrame, order: Sequence) -> DataFrame:
    """Globally sorted rows with a stable partition number and position."""
    stable = durable(df.orderBy(*order))
    return stable.select(
        "*",
        F.spark_partition_id().alias(PART),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)).alias(POS))


def row_numbers(df: DataFrame, order: Sequence, name: str,
                by: Sequence[str] = ()) -> DataFrame:
    """Dense 1..n in the given total order, restarted for each group of ``by``."""
    by = list(by)
    rows = sorted_partitions(df, [F.col(c) for c in by] + list(order))
    # One row per (partition, group) that meets; groups span whole partitions.
    sizes = rows.groupBy(PART, *by).agg(F.count("*").alias("_n"),
                                        F.min(POS).alias("_first"))
    ahead = W.partitionBy(*by).orderBy(PART) if by else W.orderBy(PART)
    offsets = sizes.select(
        PART, *by, "_first",
        (F.sum("_n").over(ahead) - F.col("_n")).alias("_before"))
    out = rows.join(offsets, [PART, *by])
    return (out.withColumn(name, F.col(POS) - F.col("_first") + F.col("_before") + 1)
            .drop(PART, POS, "_first", "_before"))


def running_sums(df: DataFrame, order: Sequence, values: Sequence[str],
                 by: Sequence[str], prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``values`` in order inside each group of ``by``."""
    by = list(by)
    rows = sorted_partitions(df, [F.col(c) for c in by] + list(order))
    totals = rows.groupBy(PART, *by).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    ahead = W.partitionBy(*by).orderBy(PART)
    offsets = totals.select(
        PART, *by,
        *[(F.sum(f"_t_{v}").over(ahead) - F.col(f"_t_{v}")).alias(f"_o_{v}")
          for v in values])
    inside = W.partitionBy(PART, *by).orderBy(POS).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    local = rows.select("*", *[F.sum(v).over(inside).alias(f"_c_{v}") for v in values])
    out = local.join(offsets, [PART, *by])
    return out.select(
        *df.columns,
        *[(F.col(f"_c_{v}") + F.col(f"_o_{v}")).alias(f"{prefix}{v}") for v in values])


def vocabulary(df: DataFrame, column: str) -> list:
    """Distinct values in order, of a column whose values follow a vocabulary, not the rows."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().collect()
    return sorted(r[0] for r in rows)


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Bag union by column name."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def union_set(frames: Sequence[DataFrame]) -> DataFrame:
    """Set union by column name."""
    return union_all(frames).distinct()
