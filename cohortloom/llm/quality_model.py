"""Quality: regularised quadratic discriminant analysis of document statistics.

Each text is reduced to a short vector of statistics (lengths, shares of kinds of
characters, share of distinct words and lines), transformed by logarithms and
square roots so that each class is closer to a normal distribution.  Means and
covariances of both classes come from all training rows by one distributed
aggregation; covariances are shrunk toward their diagonal and toward the pooled
one.  The score is the logistic of the difference of the log densities, computed
from Mahalanobis distances with Cholesky factors that are made once.

Defined results: null texts count as empty; an empty text has zero statistics and
gets a score like any other; very long texts are read whole; rows that repeat an
id count and score each time; without training rows of both classes every score
is the share of label 1 (0.0 without any row); null ids are held out; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import documents, held_out, stored
from cohortloom.llm.labelled import training_labels

STATISTICS = ("log_words", "log_word_bytes", "symbols", "pipes", "exclaims", "digits", "capitals",
              "marks", "log_line_words", "distinct_words", "distinct_pairs", "top_word",
              "distinct_lines")
SHRINK = 0.1             # toward the diagonal
POOL = 0.05              # toward the pooled covariance
_RIDGE = 1e-6

# Kinds of bytes.
_KINDS = [np.frombuffer(k, np.uint8) for k in (
    b"#*$%&|<>", b"|", b"!", b"0123456789", bytes(range(65, 91)), b".,;:?")]


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one UTF-8 text."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return [
        math.log1p(n), math.log(solid / n),
        *(math.sqrt(min(1.0, int(histogram[k].sum()) / solid)) for k in _KINDS),
        math.log1p(n / len(lines)),
        math.sqrt(len(set(words)) / n),
        math.sqrt(len(set(zip(words, words[1:]))) / max(n - 1, 1)),
        math.sqrt(Counter(words).most_common(1)[0][1] / n),
        math.sqrt(len(set(lines)) / len(lines)),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"")
                for t in batch.column(1)]
        columns = np.array(rows).T if rows else np.empty((len(STATISTICS), 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.float64()) for c in columns)],
            ["doc_id", *STATISTICS])


def document_statistics(docs: DataFrame) -> DataFrame:
    picked = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(
        _statistics, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray       # inverse of the Cholesky factor
    offset: float            # log prior less half the log determinant


@dataclass(frozen=True)
class QuadraticModel:
    """Two classes, or a constant score where one is missing."""

    classes: tuple[Gaussian, Gaussian] | None
    constant: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.constant)
        logs = []
        for g in self.classes:
            z = (x - g.mean) @ g.factor.T
            logs.append(g.offset - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = SHRINK,
        pool: float = POOL) -> QuadraticModel:
    """Class moments of all labelled rows, in one aggregation of two rows."""
    k = len(STATISTICS)
    rows = stats.join(training_labels(labels, label), "doc_id")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = {r["label"]: r for r in rows.groupBy("label").agg(
        F.count("*").alias("n"), *[F.avg(s).alias(f"m{i}") for i, s in enumerate(STATISTICS)],
        *[F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()}
    n = {c: moments[c]["n"] if c in moments else 0 for c in (0, 1)}
    if not n[0] or not n[1]:
        return QuadraticModel(None, n[1] / max(n[0] + n[1], 1))
    covariances = {}
    for c, row in moments.items():
        m = np.zeros((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"c{i}_{j}"]
        covariances[c] = m
    pooled = sum(n[c] * covariances[c] for c in (0, 1)) / (n[0] + n[1])
    out = []
    for c in (0, 1):
        s = (1 - pool) * covariances[c] + pool * pooled
        s = (1 - shrink) * s + shrink * np.diag(np.diag(s)) + _RIDGE * np.eye(k)
        lower = np.linalg.cholesky(s)
        out.append(Gaussian(np.array([moments[c][f"m{i}"] for i in range(k)]), np.linalg.inv(lower),
                            math.log(n[c] / (n[0] + n[1])) - float(np.log(np.diag(lower)).sum())))
    return QuadraticModel((out[0], out[1]))


def _score_task(model: QuadraticModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(s).to_numpy(zero_copy_only=False)
                                 for s in STATISTICS])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    return run


def score(stats: DataFrame, model: QuadraticModel) -> DataFrame:
    """(doc_id, score) for every row of statistics."""
    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(_score_task(model), f"doc_id {kind}, score double")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(document_statistics(documents(spark, sf_dir)))
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(stats, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op5_quality_model": op5_quality_model}
ORACLE: dict[str, str] = {}
