"""Logical names to stored tables: three namespaces, aliases, tags and writers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from cohortloom.functions.distributed import durable
from cohortloom.sources.files import write_csv

# Where results go in each execution mode.
_TABLE_MODES = ("development", "production")
_FILE_MODES = ("production", "distribution")


@dataclass(frozen=True)
class TableCatalog:
    """Scans and sinks by logical name.

    A namespace is a database name, or a folder (it then contains a slash) that
    holds one Parquet table per name.
    """

    spark: SparkSession
    cdm: str
    vocabulary: str
    results: str
    aliases: dict[str, str] = field(default_factory=dict)
    results_tag: str | None = None
    local_tag: str | None = None
    mode: str = "development"
    csv_folder: str | None = None
    local_csv_folder: str | None = None
    buckets: int = 512

    # names ---------------------------------------------------------------
    @staticmethod
    def add_name_tag(name: str, tag: str | None) -> str:
        """Append the tag unless the name already ends in it."""
        return name if not tag or name.endswith(tag) else name + tag

    def intermed_name(self, name: str, results_tag: bool | str = True,
                      local: bool = False) -> str:
        """Logical name with alias and tags applied."""
        name = self.aliases.get(name, name)
        tag = self.results_tag if results_tag is True else results_tag or None
        name = self.add_name_tag(name, tag)
        return self.add_name_tag(name, self.local_tag) if local else name

    @staticmethod
    def qualify(namespace: str, name: str) -> str:
        """Physical table name or path."""
        if "/" in namespace:
            return f"{namespace.rstrip('/')}/{name}"
        return f"{namespace}.{name}" if namespace else name

    def results_name(self, name: str, results_tag: bool | str = True,
                     local: bool = False) -> str:
        return self.qualify(self.results, self.intermed_name(name, results_tag, local))

    # scans ---------------------------------------------------------------
    def _scan(self, physical: str) -> DataFrame:
        if "/" in physical:
            return self.spark.read.parquet(physical)
        return self.spark.table(physical)

    def cdm_tbl(self, name: str) -> DataFrame:
        """Fact table."""
        return self._scan(self.qualify(self.cdm, self.aliases.get(name, name)))

    def vocabulary_tbl(self, name: str) -> DataFrame:
        """Vocabulary table."""
        return self._scan(self.qualify(self.vocabulary, self.aliases.get(name, name)))

    def results_tbl(self, name: str, results_tag: bool | str = True,
                    local: bool = False) -> DataFrame:
        """Earlier result."""
        return self._scan(self.results_name(name, results_tag, local))

    # sinks ---------------------------------------------------------------
    def _write(self, df: DataFrame, physical: str, partition_by: list[str] | None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if "/" in physical:
            writer.parquet(physical)
        else:
            writer.saveAsTable(physical)
        return self._scan(physical)

    def output_tbl(self, df: DataFrame, name: str, local: bool = False,
                   results_tag: bool | str = True,
                   partition_by: list[str] | None = None) -> DataFrame:
        """Permanent result as table, CSV or both, as the execution mode says."""
        out = df
        if self.mode in _TABLE_MODES:
            out = self._write(df, self.results_name(name, results_tag, local), partition_by)
        if self.mode in _FILE_MODES:
            folder = self.local_csv_folder if local else self.csv_folder
            if folder is None:
                raise ValueError(f"mode {self.mode} needs a CSV folder")
            logical = self.intermed_name(name, results_tag, local)
            write_csv(out, f"{folder.rstrip('/')}/{logical}.csv")
        return out

    def bucketed(self, df: DataFrame, name: str, namespace: str | None = None,
                 key: str = "person_id", sort_by: Sequence[str] = ()) -> DataFrame:
        """Store a table by the person, in ``buckets`` files that are sorted inside.

        Tables of one catalog have equal buckets, so joins and groupings by the person need
        no exchange, however often they run.  Needs a database, as folders keep no buckets.
        A person with a large share of all rows would fill one bucket: store such a table
        plainly, so that the adaptive skew join can split it.
        """
        physical = self.results_name(name) if namespace is None else self.qualify(namespace, name)
        if "/" in physical:
            raise ValueError("buckets need a database, not a folder")
        (df.repartition(self.buckets, key).write.mode("overwrite").format("parquet")
         .bucketBy(self.buckets, key).sortBy(key, *sort_by).saveAsTable(physical))
        return self._scan(physical)

    def copy_to_new(self, rows, name: str, schema=None) -> DataFrame:
        """Local rows as a table, replacing an older one."""
        return self._write(self.spark.createDataFrame(rows, schema),
                           self.results_name(name), None)

    def compute_new(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Materialise: under a name as a table, otherwise in the checkpoint folder."""
        if name is None:
            return durable(df)
        return self._write(df, self.results_name(name), None)

    # existence and small results --------------------------------------------
    def _path(self, physical: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(physical)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        """Is there a result of that name?"""
        physical = self.results_name(name)
        if "/" in physical:
            path, fs = self._path(physical)
            return fs.exists(path)
        return self.spark.catalog.tableExists(physical)

    def remove(self, name: str) -> None:
        """Drop a result if it exists."""
        physical = self.results_name(name)
        if "/" in physical:
            path, fs = self._path(physical)
            fs.delete(path, True)
        else:
            self.spark.sql(f"DROP TABLE IF EXISTS {physical}")

    @staticmethod
    def collect_new(df: DataFrame, limit: int) -> list:
        """A result of at most ``limit`` rows on the driver; fails beyond the caller's bound."""
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} rows; keep the result distributed")
        return rows

    @classmethod
    def pull(cls, df: DataFrame, column: str | Column, limit: int) -> list:
        """One column of a small result."""
        return [r[0] for r in cls.collect_new(df.select(column), limit)]
