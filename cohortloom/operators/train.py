"""Training, cross-validation, grid search and artefacts of MLlib models."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark import SparkContext
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import PhenotypeConfig
from cohortloom.functions.distributed import checkpoint_folder, durable, stored, union_all
from cohortloom.operators.assemble import (common_features, feature_vectors, label3,
                                           vector_layout)
from cohortloom.operators.metrics import rank_metrics, score_multiclass, threshold_metrics

# Rows of a training partition: boosting runs many short jobs over small vectors.
_ROWS = 20_000


def fit_scaler(vectors: DataFrame) -> ElementwiseProduct:
    """Division by the population deviation of the given rows; a constant slot keeps 1.

    The same deviation as ``assemble.feature_stats``.  Nothing is centred, so vectors
    stay sparse; trees ignore shifts.
    """
    row = vectors.select(Summarizer.metrics("variance", "count").summary(
        F.col("features")).alias("s")).select("s.variance", "s.count").first()
    n = max(row["count"], 1)
    spread = [math.sqrt(max(v, 0.0) * (n - 1) / n) for v in row["variance"]]
    return ElementwiseProduct(scalingVec=Vectors.dense([1 / s if s > 1e-12 else 1.0 for s in spread]),
                              inputCol="features", outputCol="scaled")


def _compact(vectors: DataFrame) -> DataFrame:
    """Vectors stored in as few partitions as their number asks for."""
    kept = durable(vectors)
    return kept.coalesce(max(1, math.ceil(kept.count() / _ROWS)))


def random_forest(cfg: PhenotypeConfig = PhenotypeConfig(), features: str = "scaled"):
    """Multiclass forest with native probabilities (boosting: ``operators.boosting``)."""
    return RandomForestClassifier(
        featuresCol=features, labelCol="label", numTrees=cfg.trees, maxDepth=cfg.tree_depth,
        featureSubsetStrategy=str(cfg.column_sample), seed=cfg.seed)


def class_probabilities(scored: DataFrame, classes: int = 3) -> DataFrame:
    """p0..pk from a model's probabilities, summing to 1."""
    total = F.aggregate("_raw", F.lit(0.0), lambda a, b: a + b)
    rows = scored.withColumn("_raw", vector_to_array("probability"))
    return rows.select(
        *[c for c in ("person_id", "fold") if c in scored.columns],
        F.col("label").cast("int").alias("y3"),
        *[(F.coalesce(F.get(F.col("_raw"), F.lit(k)), F.lit(0.0)) / total).alias(f"p{k}")
          for k in range(classes)])


@dataclass(frozen=True)
class FoldData:
    """Vectors of one split, with the slot names."""

    train: DataFrame
    test: DataFrame
    names: tuple[str, ...]


def fold_vectors(cohort: DataFrame, train_long: DataFrame, test_long: DataFrame,
                 fold: int, label: Column | None = None) -> FoldData:
    """Train and test vectors over the features both sets have; three classes by default."""
    labelled = cohort.withColumn("label", (label3() if label is None else label).cast("double"))
    shared = stored(common_features(train_long, test_long))
    domains = train_long.select("domain", "feature_key").distinct()
    flag_keys, count_keys = vector_layout(domains.join(shared, "feature_key", "left_semi"))
    parts = [feature_vectors(members, long, flag_keys, count_keys)
             for members, long in ((labelled.filter(F.col("fold") != fold), train_long),
                                   (labelled.filter(F.col("fold") == fold), test_long))]
    return FoldData(_compact(parts[0]), _compact(parts[1]), (*flag_keys, *count_keys))


def fit_scaled(train: DataFrame, estimator) -> PipelineModel:
    """Scaler and model fitted on the training vectors."""
    checkpoint_folder(train.sparkSession)
    return _bare(Pipeline(stages=[fit_scaler(train), estimator]).fit(train))


def train_cv(cohort: DataFrame, fold_longs: Mapping[int, tuple[DataFrame, DataFrame]],
             estimator, cfg: PhenotypeConfig = PhenotypeConfig(),
             fit_each: bool = False) -> DataFrame:
    """Out-of-fold class probabilities.

    ``fold_longs`` gives the (train, test) feature rows of each fold.  The
    scaler is fitted on the training part; ``fit_each`` rescales the test part
    by its own deviation instead.  Folds are fitted side by side: each runs many
    short jobs that leave room for the others.
    """
    def one(fold: int) -> DataFrame:
        data = fold_vectors(cohort, *fold_longs[fold], fold)
        fitted = fit_scaled(data.train, estimator.copy())
        if fit_each:
            scored = fitted.stages[-1].transform(fit_scaler(data.test).transform(data.test))
        else:
            scored = fitted.transform(data.test)
        return class_probabilities(scored).withColumn("fold", F.lit(fold))

    with ThreadPoolExecutor(len(fold_longs)) as pool:
        return union_all(list(pool.map(one, fold_longs)))


def cv_metrics(predictions: DataFrame,
               thresholds: Sequence[float] = PhenotypeConfig.thresholds) -> DataFrame:
    """Metrics per fold, task and threshold."""
    return score_multiclass(predictions, thresholds, ("fold",))


# The six metrics of a binary model.
SCORES = ("accuracy", "precision", "recall", "auroc", "average_precision", "f1")


def _bare(fitted: Model) -> Model:
    """The model without its training summary.

    A summary holds the session and goes to the tasks with the model, which fails once an
    ``Observation`` was used, since sessions can't be serialized from then on.
    """
    for stage in getattr(fitted, "stages", [fitted]):
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return fitted


def _scored(fitted, test: DataFrame, *keys) -> DataFrame:
    """True class, probability of class 1, and the class the model itself predicts."""
    return _bare(fitted).transform(test).select(
        *keys, F.col("label").cast("int").alias("y"),
        vector_to_array("probability")[1].alias("p"), F.col("prediction").alias("predicted"))


def _six(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    chosen = threshold_metrics(scored.withColumn("p", F.col("predicted")), [0.5], ">", by)
    return chosen.join(rank_metrics(scored, by), list(by)).select(*by, *SCORES)


def model_score(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    """Fit a binary model and score its own predictions on the test set."""
    scored = _scored(estimator.fit(train), test, F.lit("all").alias("task"))
    return _six(scored, ["task"]).drop("task")


def model_eval(estimator, train: DataFrame | Mapping[int, FoldData],
               param_grid: Mapping[str, Sequence] | None = None, refit: str = "auroc",
               folds: int = 5, fold_col: str | None = None, seed: int = 0) -> DataFrame:
    """(params, split, metric, value, best): six metrics of every parameter set and split.

    ``best`` marks the parameter set with the largest mean of the ``refit`` metric.
    Without a grid there is one set, the estimator as given.  Vectors that each split has to
    itself, such as those of features chosen by its training part, are passed by split.
    """
    if refit not in SCORES:
        raise ValueError(f"refit is one of {SCORES}")
    builder = ParamGridBuilder()
    for name, values in (param_grid or {}).items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    if isinstance(train, Mapping):
        parts = train
    else:
        split = (F.col(fold_col) if fold_col else F.floor(F.rand(seed) * folds) + 1).cast("int")
        rows = durable(train.withColumn("_split", split))
        parts = {r[0]: FoldData(rows.filter(F.col("_split") != r[0]),
                                rows.filter(F.col("_split") == r[0]), ())
                 for r in rows.select("_split").distinct().orderBy("_split").collect()}

    def one(task) -> DataFrame:
        params, k = task
        name = ", ".join(f"{p.name}={v}" for p, v in params.items()) or "default"
        fitted = estimator.fit(parts[k].train, params)
        return _scored(fitted, parts[k].test, F.lit(name).alias("params"), F.lit(k).alias("split"))

    with ThreadPoolExecutor(4) as pool:
        scored = union_all(list(pool.map(one, [(g, k) for g in builder.build() for k in parts])))
    scores = stored(_six(durable(scored), ["params", "split"]))
    best = scores.groupBy("params").agg(F.avg(refit).alias("_mean")).agg(
        F.max_by("params", F.struct("_mean", "params"))).first()[0]
    metric = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                 for m in SCORES])).alias("m")
    return scores.select("params", "split", metric).select(
        "params", "split", "m.metric", "m.value", (F.col("params") == F.lit(best)).alias("best"))


def train_full(cohort: DataFrame, long: DataFrame, estimator
               ) -> tuple[PipelineModel, DataFrame, list[str]]:
    """(model, scaled vectors, slot names) of a fit on everybody."""
    flag_keys, count_keys = vector_layout(long)
    vectors = _compact(feature_vectors(cohort.withColumn("label", label3().cast("double")),
                                       long, flag_keys, count_keys))
    fitted = fit_scaled(vectors, estimator)
    return fitted, fitted.stages[0].transform(vectors), [*flag_keys, *count_keys]


def save_model(model: Model | PipelineModel, path: str) -> None:
    """Persist a fitted model, replacing an older one."""
    model.write().overwrite().save(path)
