"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints.  Words are runs outside blanks of the text with A-Z lowered;
   every 3-word shingle, repeats included, votes with the bits of its XXH64
   (seed 42).  A bit is 1 if more than half of the shingles set it.
2. Equal fingerprints are merged: all that follows works on distinct ones.
3. Bits that correlate over all fingerprints are grouped into 2 to ``tau + 1`` partitions.
   Two fingerprints with at most ``tau`` differing bits agree on some partition
   ``i`` up to ``t_i`` bits whenever ``sum(t_i + 1) = tau + 1``.  Candidate counts
   of each partition and threshold are estimated from all fingerprints, and
   dynamic programming allots the thresholds with the smallest total, for the
   number of partitions that is cheapest.
4. Probing.  A fingerprint's keys are its partition with every choice of ``t_i``
   bits masked out.  Keys met by one fingerprint only vanish.  A key with more
   than ``max_bucket`` fingerprints is dealt into chunks, and every two chunks are a
   bucket: a task holds a bounded number of fingerprints, and no pair is left out.
5. Each bucket is searched exactly, and returns links that span the groups it
   finds instead of all pairs.  Components are joined over all buckets.

Defined results: null, empty and blank texts have fingerprint zero, which is
linked like any other; texts of one or two words have one shingle, the whole
sequence; repeated rows keep their own row; null ids are never the smallest id
unless a whole group has none (its component is null); other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import connect, documents, stored

BITS = 64
SEED = 42
SHINGLE = 3
TAU = 3
MAX_BUCKET = 16_384
KEY_COST = 100  # a key that is shuffled costs as much as this many comparisons


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text as a signed 64-bit number."""
    # bytes.lower and bytes.split know ASCII letters and the six ASCII blanks only.
    words = text.lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if n > 0 else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    block = np.fromiter((digest(g, seed) for g in grams), np.uint64)
    for at in range(0, len(block), 8192):  # bounds the unpacked bits
        part = block[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(block), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, bytes of a text, gives way to the fingerprint."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        got = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.int64())],
                                         [*batch.schema.names[:-1], "fp"])


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``fp``; a column of this name is replaced."""
    names = [c for c in docs.columns if c != "fp"]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*names, F.col(text).cast("string").cast("binary").alias("_body")).mapInArrow(
        _fingerprints, schema + "fp bigint")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return with_fingerprint(picked, "_text").select("doc_id", "fp")


def _unpack(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")


def _bit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        bits = _unpack(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        for at in range(0, len(bits), 65_536):
            part = bits[at:at + 65_536]
            total += part.T @ part
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(i * BITS + j, pa.int32()), pa.array(total[i, j].astype(np.int64))], ["cell", "n"])


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Equal partitions of the bits; each starts a new one and takes its closest bits.

    ``both[i, j]`` counts fingerprints with bits i and j set.
    """
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(left, key=lambda b: near[b, left].sum())
        group = sorted(left, key=lambda b: (b != first, -near[first, b], b))[:size]
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def allot(costs: list[dict[int, float]], budget: int) -> list[int]:
    """Thresholds (-1: partition unused) with sum(t + 1) = budget and the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, budget - used):
                at, value = used + t + 1, total + (cost[t] if t >= 0 else 0.0)
                if at not in step or value < step[at][0]:
                    step[at] = (value, [*chosen, t])
        best = step
    return best[budget][1]


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def plan(fps: DataFrame, tau: int = TAU) -> tuple[list[list[int]], list[int]]:
    """Partitions of the bits and their thresholds, from all distinct fingerprints.

    Tries 2 to tau + 1 partitions: few wide ones cost more keys a fingerprint, many
    narrow ones more candidates, so the best number grows with the data.
    """
    cells = (fps.mapInArrow(_bit_sums, "cell int, n bigint")
             .groupBy("cell").agg(F.sum("n").alias("n")).collect())  # 64 x 64 at most
    n = fps.count()
    both = np.zeros((BITS, BITS))
    for row in cells:
        both[row["cell"] // BITS, row["cell"] % BITS] = row["n"]
    layouts = [group_bits(both, n, parts) for parts in range(2, tau + 2)]
    flat = [group for groups in layouts for group in groups]
    # Pairs that agree on a whole partition, counted over all; one number for each.
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(
        F.lit(_as_long(_mask(group)))).alias("k")) for i, group in enumerate(flat)])
    same = {r["i"]: r["pairs"] for r in (
        fps.select(F.explode(keys).alias("x")).groupBy("x")
        .agg(F.count("*").cast("double").alias("c"))
        .groupBy("x.i").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect())}
    p = np.diag(both) / max(n, 1)
    costs = []
    for i, group in enumerate(flat):
        # Chance of d differing bits if bits were independent, scaled to the counted d = 0.
        chance = np.array([1.0])
        for b in group:
            differ = 2 * p[b] * (1 - p[b])
            chance = np.convolve(chance, [1 - differ, differ])
        scale = max(same.get(i, 0.0), 1.0) / max(chance[0] * n * n / 2, 1e-9)
        costs.append({t: comb(len(group), t) * (KEY_COST * n + min(
            float(scale * chance[:t + 1].sum()), 1.0) * n * n / 2)
            for t in range(min(tau, len(group)) + 1)})
    best, at = None, 0
    for groups in layouts:
        own = costs[at:at + len(groups)]
        at += len(groups)
        chosen = allot(own, tau + 1)
        total = sum(c[t] for c, t in zip(own, chosen) if t >= 0)
        if best is None or total < best[0]:
            best = (total, groups, chosen)
    return best[1], best[2]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def span(fps: np.ndarray, tau: int = TAU) -> list[tuple[int, int]]:
    """Links of a forest that connects what pairs within ``tau`` bits connect.

    Grows one group at a time: every member is compared once with what no group
    holds yet, so dense groups shrink the rest at once.
    """
    rest, links = np.unique(fps), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _popcount(rest ^ at) <= tau
            if near.any():
                found = rest[near]
                links.extend((int(at), int(f)) for f in found)
                queue.extend(found)
                rest = rest[~near]
    return links


def _spans(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Buckets arrive sorted by key, so that one bucket is held at a time."""
    held_key, held, links = None, [], []

    def flush():
        if held:
            links.extend(span(np.concatenate(held), tau))

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "mask", "key", "pair"))))
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if keys[a] != held_key:
                    flush()
                    held_key, held = keys[a], []
                held.append(fps[a:b])
        if len(links) > 50_000:
            yield _link_batch(links)
            links = []
    flush()
    yield _link_batch(links)


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


KEY = ["part", "mask", "key"]


def _keys(fps: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """A row for each fingerprint and key; masks hold the bits that a key fixes."""
    choices = []
    for i, (group, t) in enumerate(zip(groups, thresholds)):
        for out in combinations(group, t) if t >= 0 else ():
            fixed = _as_long(_mask([b for b in group if b not in out]))
            choices.append(F.struct(F.lit(i).alias("part"), F.lit(fixed).alias("mask")))
    return (fps.select("fp", F.explode(F.array(*choices)).alias("c"))
            .select("c.part", "c.mask", F.col("fp").bitwiseAND(F.col("c.mask")).alias("key"),
                    "fp"))


def candidate_buckets(fps: DataFrame, groups: list[list[int]], thresholds: list[int],
                      max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Rows of buckets with at least two fingerprints.

    A bucket of more than ``max_bucket`` is dealt into k chunks by hash, and every two
    chunks make a bucket of their own: each pair of members still meets somewhere.
    """
    rows = _keys(fps, groups, thresholds)
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, KEY).withColumn("_k", F.ceil(F.col("n") / max_bucket).cast("int"))
    chunk = F.pmod(F.hash("fp"), F.col("_k"))
    pairs = F.when(F.col("_k") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("_k") - 1),
        lambda j: F.least(j, chunk).cast("long") * F.col("_k") + F.greatest(j, chunk)))
    return rows.withColumn("pair", F.explode(pairs)).select(*KEY, "pair", "fp")


def simhash_links(fps: DataFrame, tau: int = TAU,
                  max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every group."""
    buckets = candidate_buckets(fps, *plan(fps, tau), max_bucket)
    return (buckets.repartition(*KEY, "pair").sortWithinPartitions(*KEY, "pair")
            .mapInArrow(lambda it: _spans(it, tau), "a bigint, b bigint"))


def _named(rows: DataFrame, tau: int, max_bucket: int) -> DataFrame:
    """(fp, low, root): the smallest id of each fingerprint and the name of its group."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    star = connect(simhash_links(distinct.select("fp"), tau, max_bucket))
    return distinct.join(star, distinct["fp"] == star["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root"))


def simhash_groups(docs: DataFrame, tau: int = TAU, max_bucket: int = MAX_BUCKET,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest id of each document's group."""
    rows = stored(fingerprints(docs, doc_id, text))
    named = _named(rows, tau, max_bucket)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lows, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, tau: int = TAU, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """The row with the smallest id of each group (of rows that repeat it, any one)."""
    named = _named(stored(fingerprints(docs)), tau, max_bucket)
    first = F.struct(F.col("low").isNull(), "low", "fp")
    keep = stored(named.groupBy("root").agg(F.min(first).alias("k")).select(
        F.col("k.low").alias("_id"), F.col("k.fp").alias("_fp")))
    rows = with_fingerprint(docs)
    kept = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_id"]) & (rows["fp"] == keep["_fp"]),
                     "left_semi")
    return kept.dropDuplicates(["doc_id", "fp"]).drop("fp")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLE: dict[str, str] = {}
