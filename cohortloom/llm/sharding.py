"""Sharding through fixed virtual slots and a stored, versioned slot map.

Records are hashed into ``SLOTS`` virtual slots, for good.  Bytes and rows are
summed for each slot, and a map sends slots to shards: the first version gives
the largest slot left to the lightest shard; rebalancing edits a copy of the
newest version, moving as few bytes as even out the shards, and stores it as the
next one.  Only the map, ``SLOTS`` rows whatever the data, meets the driver.

The law is bytes, so a record's slot follows from its id, its size and checksum, and
its number among the records that agree in all three: neither an id nor a text that
many rows share fills a slot.  Equal records are counted, which combines before the
shuffle, and numbered in chunks.

Defined results: a null text has no bytes (size 1, like the empty text); rows that
agree in id are spread over the slots; very long texts stay whole; an empty table gives an empty result
and an even map; other columns are never read.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cohortloom.functions.distributed import checkpoint_folder
from cohortloom.llm.common import documents, stored, utf8

SLOTS = 8192
SHARDS = 16
CHUNK = 4096  # equal records numbered by one row
MAP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType()),
                           T.StructField("vslot", T.IntegerType()),
                           T.StructField("shard", T.IntegerType()),
                           T.StructField("rows_ahead", T.LongType())])


def virtual_slot(record: list[str], slots: int = SLOTS) -> Column:
    """Slot of a record, from the columns that tell it from all others."""
    return F.pmod(F.xxhash64(*record), F.lit(slots)).cast("int")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``_nr``, 0 to n - 1 among n equal rows; no task holds all of them."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    chunks = counted.withColumn("_c", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))))
    return (chunks.repartition(*rows.columns, "_c")
            .withColumn("_nr", F.explode(F.sequence(
                F.col("_c") * CHUNK, F.least((F.col("_c") + 1) * CHUNK, F.col("_n")) - 1)))
            .drop("_n", "_c"))


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) without the texts."""
    body = utf8(text)
    rows = numbered(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32")))
    return rows.withColumn("vslot", virtual_slot(rows.columns, slots)).drop("_nr")


def slot_sums(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of every slot that has any: at most ``SLOTS`` rows."""
    return {r["vslot"]: (r["size"], r["n"]) for r in rows.groupBy("vslot").agg(
        F.sum("size").alias("size"), F.count("*").alias("n")).collect()}


def first_map(sums: dict[int, tuple[int, int]], shards: int = SHARDS,
              slots: int = SLOTS) -> dict[int, int]:
    """The largest slot left goes to the lightest shard."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda v: (-sums.get(v, (0, 0))[0], v)):
        load, shard = heapq.heappop(loads)
        out[slot] = shard
        heapq.heappush(loads, (load + sums.get(slot, (0, 0))[0], shard))
    return out


def rebalanced(old: dict[int, int], sums: dict[int, tuple[int, int]],
               shards: int) -> dict[int, int]:
    """An edit of a map: slots move from overfull shards to underfull ones only."""
    size = {v: sums.get(v, (0, 0))[0] for v in old}
    goal = sum(size.values()) / shards
    load, held = defaultdict(int), defaultdict(list)
    homeless, new = [], {}
    for v, shard in sorted(old.items()):
        if shard < shards:
            new[v] = shard
            load[shard] += size[v]
            held[shard].append(v)
        else:
            homeless.append(v)
    for shard in range(shards):  # give up what exceeds the goal, small slots first
        for v in sorted(held[shard], key=lambda x: (size[x], x)):
            if load[shard] - size[v] < goal:
                break
            load[shard] -= size[v]
            homeless.append(v)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for v in sorted(homeless, key=lambda x: (-size[x], x)):
        at, shard = heapq.heappop(heap)
        new[v] = shard
        heapq.heappush(heap, (at + size[v], shard))
    return new


def store_map(spark: SparkSession, path: str, version: int, slot_shard: dict[int, int],
              sums: dict[int, tuple[int, int]]) -> DataFrame:
    """Append a version; ``rows_ahead`` counts the rows of earlier slots of the shard."""
    ahead: dict[int, int] = defaultdict(int)
    rows = []
    for v, shard in sorted(slot_shard.items()):
        rows.append((version, v, shard, ahead[shard]))
        ahead[shard] += sums.get(v, (0, 0))[1]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest unless told."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version).drop("version")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of every record and its place there, gapless from 0.

    Places are counted inside virtual slots, a small and fixed share of a shard,
    and shifted by the rows of the slots ahead.  The map has a fixed number of rows.
    """
    inside = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("_at", F.row_number().over(inside) - 1)
            .join(F.broadcast(slot_map), "vslot")
            .withColumn("slot", (F.col("_at") + F.col("rows_ahead")).cast("long"))
            .drop("_at", "rows_ahead"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(records(documents(spark, sf_dir)))
    sums = slot_sums(rows)
    path = f"{checkpoint_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    slot_map = store_map(spark, path, 0, first_map(sums), sums)
    return place(rows, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot")


QUERIES = {"op8_sharding": op8_sharding}
ORACLE: dict[str, str] = {}
