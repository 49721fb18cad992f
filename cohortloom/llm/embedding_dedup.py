"""Embedding near-duplicates through one small-world graph per shard.

Vectors that are equal, label and all, are merged first, so any number of copies is
one node that carries its count.  The vectors of a label are dealt into shards of
about ``SHARD`` nodes, and a hierarchical navigable small-world graph is built for
each.  The beam of a shard starts narrow and doubles until an audit of its members
against brute force has the recall asked for; a shard that no beam serves is
compared as a whole.  Then the members of every shard query every shard of their
label; queries of other shards are audited in the same way.  Links are verified by cosine in double precision; a task returns the
number of links of each vector and links that span the groups it found, not
the pairs.  Components are joined over all tasks.

Defined results: labels that are null, and vectors that are null, empty, zero or
hold null or non-finite components, link with nothing; vectors of another length
do not link; rows that repeat an id are counted each; null ids keep null
components, and a group's component is its smallest id that is not null; an
empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import connect, stored
from cohortloom.llm.hnsw import Graph, audited_width, audited_within, build, whole, within

LEAST = 0.93
SHARD = 8192
# Single precision finds candidates; double precision decides.
SLACK = 1e-4


def usable(label: str = "label", vector: str = "embedding"):
    """True for rows that can link."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(label).isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)   # no overflow of squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


INDEX_SCHEMA = ("group long, shard int, width int, recall double, dim int, rids binary, "
                "copies binary, vectors binary, ground binary, layers array<struct<nodes: binary, links: binary>>")


def _index_task(least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors = np.array(table["embedding"].to_pylist(), np.float64)
        unit = _unit(vectors)
        graph = build(unit.astype(np.float32))
        width, recall = audited_width(graph, least - SLACK)
        row = {
            "group": key[0].as_py(), "shard": key[1].as_py(), "width": width, "recall": recall,
            "dim": vectors.shape[1], "rids": table["rid"].to_numpy().tobytes(),
            "copies": table["copies"].to_numpy().tobytes(), "vectors": unit.tobytes(),
            "ground": graph.ground.astype(np.int32).tobytes(),
            "layers": [{"nodes": n.astype(np.int32).tobytes(), "links": k.astype(np.int32).tobytes()}
                       for n, k in graph.layers]}
        kinds = {"group": pa.int64(), "shard": pa.int32(), "width": pa.int32(),
                 "recall": pa.float64(), "dim": pa.int32(), "layers": pa.list_(pa.struct(
                     [("nodes", pa.binary()), ("links", pa.binary())]))}
        return pa.table({c: pa.array([v], kinds.get(c, pa.binary())) for c, v in row.items()})

    return run


class _Shard:
    def __init__(self, row: dict, side: str):
        def part(name):
            return row[f"{side}_{name}"]

        self.rids = np.frombuffer(part("rids"), np.int64)
        self.copies = np.frombuffer(part("copies"), np.int64)
        self.unit = np.frombuffer(part("vectors"), np.float64).reshape(len(self.rids), -1)
        self.width = part("width")
        small = self.unit.astype(np.float32)
        ground = np.frombuffer(part("ground"), np.int32).astype(np.int64)
        layers = [tuple(np.frombuffer(x[k], np.int32).astype(np.int64) for k in ("nodes", "links"))
                  for x in part("layers")]
        self.graph = Graph(small, [(n, k.reshape(len(n), -1)) for n, k in layers],
                           ground.reshape(len(self.rids), -1))

    def find(self, queries: np.ndarray, least: float) -> np.ndarray:
        """Boolean (query, node) for the members of another shard."""
        return audited_within(self.graph, queries, least - SLACK, self.width)

    def find_own(self, least: float) -> np.ndarray:
        """Boolean (query, node) for the shard's own members, by the width audited for them."""
        vectors = self.graph.vectors
        if self.width:
            return within(self.graph, vectors, least - SLACK, self.width)
        return whole(self.graph, vectors, least - SLACK)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs (a, b) connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _pair_task(least: float):
    """Two shards of a label, or one with itself: (rid, link, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one = row["a_shard"] == row["b_shard"]
                a = _Shard(row, "a")
                b = a if one else _Shard(row, "b")
                found = a.find_own(least) if one else b.find(a.graph.vectors, least)
                found |= found.T if one else a.find(b.graph.vectors, least).T
                if one:
                    np.fill_diagonal(found, False)
                x, y = np.nonzero(found)
                keep = np.empty(len(x), bool)
                for at in range(0, len(x), 100_000):
                    s = slice(at, at + 100_000)
                    keep[s] = np.einsum("ed,ed->e", a.unit[x[s]], b.unit[y[s]]) >= least
                x, y = x[keep], y[keep]
                rid = [a.rids] if one else [a.rids, b.rids]
                n = [np.bincount(x, b.copies[y], len(a.rids))]
                if not one:
                    n.append(np.bincount(y, a.copies[x], len(b.rids)))
                rids, counts = np.concatenate(rid), np.concatenate(n).astype(np.int64)
                shift = 0 if one else len(a.rids)
                links = _forest(x, y + shift, len(rids))
                some = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([rids[some], rids[[u for u, _ in links]]])),
                     pa.array([None] * int(some.sum()) + rids[[v for _, v in links]].tolist(), pa.int64()),
                     pa.array(np.concatenate([counts[some], np.zeros(len(links), np.int64)]))],
                    ["rid", "link", "n"])

    return run


def embedding_groups(rows: DataFrame, least: float = LEAST, shard: int = SHARD,
                     vec_id: str = "vec_id", vector: str = "embedding",
                     label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"),
                       F.col(label).alias("label"))
    fine = usable()
    merged = (rows.filter(fine).groupBy("label", "embedding")
              .agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")))
    # Numbers are given once and stored, so that every later read agrees.
    nodes = stored(merged.withColumn("rid", F.monotonically_increasing_id())
                   .withColumn("group", F.xxhash64("label", F.size("embedding"))))
    sizes = nodes.groupBy("group").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = nodes.join(sizes, "group").withColumn(
        "shard", F.pmod(F.xxhash64("rid"), F.col("shards")).cast("int"))
    index = stored(dealt.select("group", "shard", "rid", "copies", "embedding")
                   .groupBy("group", "shard").applyInArrow(_index_task(least), INDEX_SCHEMA))

    def side(name: str) -> DataFrame:
        return index.select(F.col("group").alias(f"{name}_group"), *[
            F.col(c).alias(f"{name}_{c}") for c in ("shard", "width", "rids", "copies", "vectors",
                                                    "ground", "layers")])

    a, b = side("a"), side("b")
    pairs = a.join(b, (a["a_group"] == b["b_group"]) & (a["a_shard"] <= b["b_shard"]))
    found = stored(pairs.repartition("a_group", "a_shard", "b_shard")
                   .mapInArrow(_pair_task(least), "rid bigint, link bigint, n bigint"))
    counts = found.filter("link is null").groupBy("rid").agg(F.sum("n").alias("n"))
    star = connect(found.filter("link is not null").select("rid", "link"))
    named = (nodes.join(counts, "rid", "left").join(star, nodes["rid"] == star["node"], "left")
             .select("label", "embedding", "low", F.coalesce("component", "rid").alias("root"),
                     (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "root").select("label", "embedding", "n_links", "component_id")
    linked = rows.filter(fine).join(named, ["label", "embedding"]).select(
        "vec_id", "n_links", "component_id")
    alone = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                      F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}
ORACLE: dict[str, str] = {}
