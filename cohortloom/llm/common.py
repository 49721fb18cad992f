"""Helpers shared by the operators: tables, expressions, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.distributed import stored

__all__ = ["SPACE", "bind", "bytes_of", "components", "connect", "discard",
           "documents", "held_out",
           "partitions_for", "slices", "stored", "utf8", "words_of"]

# The blanks that separate words (space, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SLICE = 1 << 20  # bytes of a batch that a task works at once


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterator[pa.RecordBatch], column: str | int = -1) -> Iterator[pa.RecordBatch]:
    """All rows in order, in slices of about ``SLICE`` bytes of a column, at least one row each.

    What a task makes of a slice leaves it before the next, so that it never holds the
    results of a whole batch of texts.
    """
    for batch in batches:
        values = batch.column(column if isinstance(column, str) else batch.num_columns + column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            held = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, held + SLICE, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(text: Column | str) -> Column:
    """Text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text that is not null: maximal runs without blanks."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def bytes_of(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a text column."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def partitions_for(spark: SparkSession, n_bytes: int, each: int = 16 << 20) -> int:
    """Partitions of about ``each`` bytes, no fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / each))


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of ids that no model learns from; a null id is held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(True))


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m) with m the smallest of u and its neighbours."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u")


def connect(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Stars of an undirected graph: distinct (node, component), component < node.

    ``edges`` has two columns of one orderable type.  Rounds of large-star and
    small-star (Kiveris et al. 2014): each replaces links by links to the
    smallest neighbour, so the number of links never grows beyond the first, and
    stops when a round changes nothing.  Minima are combined before shuffling;
    no neighbourhood is gathered.  Each round is written to a table.
    """
    a, b = edges.columns
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .filter("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
                     .first())

    before = mark(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_min_neighbour(both).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        near = _min_neighbour(large)
        now = stored(near.select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .union(near.select("u", F.col("m").alias("v")))
                     .filter("u <> v").distinct())
        after = mark(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
    raise RuntimeError("components did not settle")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every distinct node; a node without links is its own."""
    star = connect(edges)
    (node,) = nodes.columns
    return (nodes.join(star, nodes[node] == star["node"], "left")
            .select(nodes[node], F.coalesce("component", nodes[node]).alias("component")))
