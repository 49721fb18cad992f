"""Run all registered queries against their SQL: python -m tests.run_oracle FOLDER [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry_points
from cohortloom.functions.distributed import clear_stored
from tests.compare import difference


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def main(folder: str, names: list[str]) -> int:
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g")
             .config("spark.checkpoint.dir", "spark-warehouse/_work").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), entry_points.oracle_sql(), 0
    for name, fn in entry_points.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            note = (difference(df, con.execute(sql[name])) if name in sql
                    else None if df.collect() else "empty result")
        except Exception as e:  # report and go on
            note = f"{type(e).__name__}: {str(e)[:600]}"
        clear_stored(spark)
        bad += note is not None
        print(f"{'ok ' if note is None else 'BAD'} {name} {time.time() - start:.1f}s "
              f"{note or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
