"""Step log: one row per step with user columns, person counts and resource use."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.distributed import union_all
from cohortloom.sources.catalog import TableCatalog


class StepLog:
    """Collects steps lazily.

    Steps that write a table anyway are counted by that write (:meth:`observed`); other
    frames are counted when the log is read or written.  Every row has its ``site``, the time
    ``logged_at`` and ``used``: user, system and elapsed seconds of the driver's process.
    """

    def __init__(self, spark: SparkSession, site: str = "unknown"):
        self._spark = spark
        self._site = site
        self._rows: list = []        # frames, or what was observed with the fixed columns

    def init_sum(self, **columns) -> "StepLog":
        """Start over with a first row."""
        self._rows = []
        return self.append_sum(**columns)

    def append_sum(self, persons: DataFrame | int | None = None,
                   id_col: str = "person_id", **columns) -> "StepLog":
        """Add a row; ``persons`` may be a frame whose persons and rows are counted."""
        if isinstance(persons, DataFrame):
            row = persons.agg(F.countDistinct(id_col).alias("persons"),
                              F.count("*").alias("rows"))
        else:
            row = self._spark.range(1).select(
                F.lit(persons).cast("long").alias("persons"),
                F.lit(None).cast("long").alias("rows"))
        self._rows.append(row.withColumns(self._fixed(columns)))
        return self

    def _fixed(self, columns: dict) -> dict:
        stamp = datetime.now(timezone.utc).replace(tzinfo=None)
        t = os.times()
        return {"step_number": F.lit(len(self._rows) + 1), "site": F.lit(self._site),
                "logged_at": F.lit(stamp),
                "used": F.lit(f"{t.user:.2f};{t.system:.2f};{t.elapsed:.2f}"),
                **{name: F.lit(value) for name, value in columns.items()}}

    def observed(self, df: DataFrame, id_col: str | None = None, **columns) -> DataFrame:
        """``df``, whose next pass counts it for a new row of the log; no scan of its own.

        Without ``id_col`` a row is a person, as in cohorts.  With it persons are counted by a
        sketch, with an error of about two percent; exact distinct counts need a pass and are
        had from :meth:`append_sum`.
        """
        seen = Observation(f"step {len(self._rows) + 1}")
        persons = F.count(F.lit(1)) if id_col is None else F.approx_count_distinct(id_col, 0.02)
        self._rows.append((seen, self._fixed(columns)))
        return df.observe(seen, persons.alias("persons"), F.count(F.lit(1)).alias("rows"))

    def _row(self, row) -> DataFrame:
        if isinstance(row, DataFrame):
            return row
        seen, fixed = row
        found = seen.get       # waits for the pass that counts it
        return self._spark.range(1).select(
            *[F.lit(found[c]).cast("long").alias(c) for c in ("persons", "rows")]).withColumns(fixed)

    def frame(self) -> DataFrame:
        """The log as a frame; every observed frame must have had its pass."""
        return union_all([self._row(row) for row in self._rows], allow_missing=True)

    def output_sum(self, catalog: TableCatalog, name: str | None = None) -> DataFrame:
        """Write the log as a result, named ``{site}_steps`` unless told otherwise."""
        return catalog.output_tbl(self.frame(), name or f"{self._site}_steps")


def attrition(steps: dict[str, DataFrame], id_col: str = "person_id") -> DataFrame:
    """Persons and rows after each named step, in order."""
    return union_all([
        df.agg(F.countDistinct(id_col).alias("persons"), F.count("*").alias("rows"))
        .withColumns({"step_number": F.lit(i), "step": F.lit(name)})
        for i, (name, df) in enumerate(steps.items(), start=1)])
