"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of the lower-cased text, present or not,
hashed into 2^20 buckets.  Over the training rows, Spark counts for each bucket
the documents of either class that hold it; ``r`` is the log ratio of the smoothed
shares.  The buckets with the largest chi-square statistic are kept, and a
logistic regression is fitted on ``r * present``.  Scoring reads every whole
text and needs the kept weights alone, a vector of fixed size.

The fit reads at most ``max_rows`` labelled rows (a documented bound; the rows with
the least hashed ids) so that ids and kept buckets fit a small table whatever the
corpus; scores cover all documents.

Defined results: null texts count as empty; an empty text gets the score of a
text without any kept n-gram; very long texts are read whole, in pieces; a
document that repeats its id is learnt from once and scored each time; without
training rows of both classes every score is the share of label 1 (0.0 without
any row); null ids are held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import documents, held_out
from cohortloom.llm.labelled import training_labels

ORDERS = (3, 4, 5, 6)
BITS = 20
KEEP = 8192
MAX_ROWS = 20_000
_PIECE = 1 << 20


@dataclass(frozen=True)
class NgramModel:
    """Weights of all buckets (most are zero) and the bias."""

    weights: np.ndarray
    bias: float


def _buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of a text, piece by piece."""
    low = f" {text.lower()} "
    longest = max(ORDERS)
    for at in range(0, len(low), _PIECE):
        chars = np.frombuffer(low[at:at + _PIECE + longest - 1].encode("utf-32-le", "surrogatepass"),
                              np.uint32)
        h = chars
        for n in range(2, longest + 1):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x01000193) + chars[n - 1:]
            if n in ORDERS:
                x = h ^ (h >> np.uint32(15))
                yield (x * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS)


def _present(text: str) -> np.ndarray:
    parts = list(_buckets(text))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class for each bucket, over one partition."""
    count = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            count[label, _present(text.as_py() or "")] += 1
    used = np.flatnonzero(count.any(axis=0))
    for at in range(0, len(used), 100_000):
        part = used[at:at + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(count[0, part]), pa.array(count[1, part])],
            ["bucket", "n0", "n1"])


def _rows(kept: np.ndarray):
    """Kept buckets of each training row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[kept] = np.arange(len(kept))
        for batch in batches:
            found = []
            for text in batch.column(0):
                s = slot[_present(text.as_py() or "")]
                found.append(s[s >= 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["label", "slots"])

    return run


def log_count_ratio(n0: np.ndarray, n1: np.ndarray, total0: int, total1: int,
                    smooth: float = 1.0) -> np.ndarray:
    return (np.log((n1 + smooth) / (total1 + 2 * smooth))
            - np.log((n0 + smooth) / (total0 + 2 * smooth)))


def chi_square(n0: np.ndarray, n1: np.ndarray, total0: int, total1: int) -> np.ndarray:
    n, total = n0 + n1, total0 + total1
    cross = n1 * (total0 - n0) - n0 * (total1 - n1)
    return total * cross.astype(float) ** 2 / np.maximum(
        n.astype(float) * (total - n) * total0 * total1, 1e-9)


def fit_logistic(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, scale: np.ndarray,
                 l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of sparse rows (one entry a slot, of value ``scale``) by accelerated descent."""
    n, k = len(labels), len(scale)
    value = scale[slots]
    # Power iteration bounds the curvature, and with it the step.
    v = np.ones(k) / np.sqrt(k)
    for _ in range(15):
        v = np.bincount(slots, value * np.bincount(rows, value * v[slots], n)[rows], k)
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    rate = 1.0 / (0.25 * (top / n + 1) + l2)
    w, b, w_ahead, b_ahead, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    for _ in range(steps):
        z = np.bincount(rows, value * w_ahead[slots], n) + b_ahead
        miss = 1 / (1 + np.exp(-z)) - labels
        w_new = w_ahead - rate * (np.bincount(slots, value * miss[rows], k) / n + l2 * w_ahead)
        b_new = b_ahead - rate * miss.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_ahead = w_new + (t - 1) / t_new * (w_new - w)
        b_ahead = b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS,
        keep: int = KEEP) -> NgramModel:
    """Learn from at most ``max_rows`` labelled documents."""
    chosen = training_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows ids: the texts of all others stay where they are.
    train = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
             .join(F.broadcast(chosen), "doc_id")
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
             .select("text", "label"))
    totals = {r["label"]: r["n"] for r in train.groupBy("label").agg(
        F.count("*").alias("n")).collect()}
    total0, total1 = totals.get(0, 0), totals.get(1, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not total0 or not total1:
        share = total1 / max(total0 + total1, 1)
        return NgramModel(weights, 50.0 * (2 * share - 1) if share in (0, 1) else 0.0)
    # At most 2^20 buckets, each with two numbers.
    table = (train.mapInArrow(_counts, "bucket int, n0 bigint, n1 bigint").groupBy("bucket")
             .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
             .filter("n0 + n1 >= 3").toArrow())
    bucket, n0, n1 = (table[c].to_numpy() for c in ("bucket", "n0", "n1"))
    best = np.lexsort((bucket, -chi_square(n0, n1, total0, total1)))[:keep]
    best = best[np.argsort(bucket[best])]
    ratio = log_count_ratio(n0[best], n1[best], total0, total1)
    table = train.mapInArrow(_rows(bucket[best]), "label int, slots array<int>").toArrow()
    lists = table["slots"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    w, bias = fit_logistic(np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(),
                           table["label"].to_numpy().astype(float), ratio)
    weights[bucket[best]] = w * ratio
    return NgramModel(weights, bias)


def _score_task(used: np.ndarray, values: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float32)
        weights[used] = values
        for batch in batches:
            scores = []
            for text in batch.column(1):
                hits = []
                for b in _buckets(text.as_py() or ""):
                    hits.append(b[weights[b] != 0])
                seen = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)
                z = bias + float(weights[seen].sum(dtype=np.float64))
                scores.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: NgramModel) -> DataFrame:
    """(doc_id, score) for every row: the probability of label 1."""
    used = np.flatnonzero(model.weights)
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(_score_task(used, model.weights[used], model.bias),
                             f"doc_id {kind}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
