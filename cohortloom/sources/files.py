"""CSV exchange and Parquet tables in folders."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.distributed import union_all
from cohortloom.sources.schemas import CLUSTERS, RULES, SCAN, SCAN_HEADER


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header and declared types; columns are found by name.

    Quotes are doubled inside quoted values, empty fields are null, and values
    may hold commas.  Line breaks inside values need ``multi_line``, which reads
    each file in one task.  Header characters that a name cannot hold match a dot.
    """
    paths = [path] if isinstance(path, str) else list(path)
    header = (spark.read.option("header", True).option("escape", '"')
              .option("multiLine", multi_line).csv(paths))
    by_name = {re.sub(r"[^A-Za-z0-9._]", ".", c): c for c in header.columns}
    return header.select(*[
        F.col(f"`{by_name[f.name]}`").cast(f.dataType).alias(f.name)
        if f.name in by_name else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder with headers; nulls are written as empty fields, blanks as they are."""
    (df.write.mode("overwrite").option("header", True).option("nullValue", "")
     .option("emptyValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule table."""
    return read_csv(spark, path, RULES)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """The cluster codeset."""
    return read_csv(spark, path, CLUSTERS)


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """One tree-scan result file with dotted headers as snake-case columns."""
    raw = T.StructType([T.StructField(h, f.dataType, True)
                        for h, f in zip(SCAN_HEADER, SCAN.fields)])
    return read_csv(spark, path, raw).toDF(*[f.name for f in SCAN.fields])


def read_scans(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several scan results (``all`` and one per fold) stacked with their split name."""
    return union_all([read_scan(spark, path).withColumn("split", F.lit(split))
                      for split, path in paths.items()])
