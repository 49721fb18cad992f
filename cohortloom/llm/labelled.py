"""Labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import held_out


def training_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label) of rows to learn from: ids that are not held out, one row each.

    Null ids and labels are left out; of contradicting labels the smaller counts.
    """
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    return (rows.filter(rows["doc_id"].isNotNull() & rows["label"].isin(0, 1)
                        & ~held_out("doc_id"))
            .groupBy("doc_id").agg(F.min("label").alias("label")))
