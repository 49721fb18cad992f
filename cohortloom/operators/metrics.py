"""Classification metrics as aggregations over (group, y, p) rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import compare
from cohortloom.functions.distributed import running_sums

# One-vs-rest tasks of the 3-class label and metric names.
TASKS = ("pasc_any", "non_misc", "misc")
METRICS = ("accuracy", "recall", "specificity", "precision", "auroc", "average_precision",
           "f1", "youden_j")


def one_vs_rest(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, task, y, p): class 1, class 2, and either against the rest."""
    y = F.col("y3")

    def row(task: str, truth: Column, p: Column) -> Column:
        return F.struct(F.lit(task).alias("task"), truth.cast("int").alias("y"), p.alias("p"))

    rows = F.array(row("pasc_any", y.isin(1, 2), F.col("p1") + F.col("p2")),
                   row("non_misc", y == 2, F.col("p2")),
                   row("misc", y == 1, F.col("p1")))
    return predictions.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def confusion(scored: DataFrame, thresholds: Sequence[float], op: str = ">",
              by: Sequence[str] = ("task",)) -> DataFrame:
    """tp, fp, fn, tn per group and threshold.

    Scores are first put in the interval between thresholds, which leaves at
    most len(thresholds) + 1 rows per group to evaluate the thresholds on.
    """
    levels = sorted(set(thresholds))
    passed = None
    for k in range(len(levels), 0, -1):
        hit = compare(op, F.col("p"), F.lit(levels[k - 1]))
        passed = F.when(hit, k) if passed is None else passed.when(hit, k)
    binned = (scored.withColumn("_passed", passed.otherwise(0))
              .groupBy(*by, "_passed")
              .agg(F.sum("y").cast("long").alias("pos"),
                   F.sum(1 - F.col("y")).cast("long").alias("neg")))
    sums = [F.sum("pos").alias("_p"), F.sum("neg").alias("_n")]
    for k in range(len(levels)):
        over = F.col("_passed") > k
        sums += [F.sum(F.when(over, F.col("pos")).otherwise(0)).alias(f"_tp{k}"),
                 F.sum(F.when(over, F.col("neg")).otherwise(0)).alias(f"_fp{k}")]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{k}").alias("tp"),
                              F.col(f"_fp{k}").alias("fp")) for k, t in enumerate(levels)])
    return (binned.groupBy(*by).agg(*sums)
            .select(*by, "_p", "_n", F.explode(rows).alias("r"))
            .select(*by, "r.threshold", "r.tp", "r.fp",
                    (F.col("_p") - F.col("r.tp")).alias("fn"),
                    (F.col("_n") - F.col("r.fp")).alias("tn")))


def _ratio(top: Column, bottom: Column) -> Column:
    """0 when the denominator is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def threshold_metrics(scored: DataFrame, thresholds: Sequence[float], op: str = ">",
                      by: Sequence[str] = ("task",)) -> DataFrame:
    """Accuracy, recall, precision, specificity, F1 and Youden J per threshold."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return confusion(scored, thresholds, op, by).select(
        *by, "threshold",
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        recall.alias("recall"),
        _ratio(tp, tp + fp).alias("precision"),
        specificity.alias("specificity"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (recall + specificity - 1).alias("youden_j"))


def rank_metrics(scored: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """AUROC (ties count one half) and average precision (sum of recall steps times precision).

    Rows shrink to distinct scores; cumulative counts from the highest score
    down come from partition-wise running sums.
    """
    by = list(by)
    scores = scored.groupBy(*by, "p").agg(
        F.sum("y").cast("double").alias("pos"),
        F.sum(1 - F.col("y")).cast("double").alias("neg"))
    down = running_sums(scores, [F.desc("p")], ["pos", "neg"], by)
    pos, neg = F.col("pos"), F.col("neg")
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    sums = down.groupBy(*by).agg(
        F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"),
        F.sum(pos * (fp - neg / 2)).alias("misranked"),
        F.sum(pos * tp / (tp + fp)).alias("steps"))
    both = (F.col("p_all") > 0) & (F.col("n_all") > 0)
    return sums.select(
        *by,
        F.when(both, 1 - F.col("misranked") / (F.col("p_all") * F.col("n_all"))).alias("auroc"),
        F.when(F.col("p_all") > 0, F.col("steps") / F.col("p_all")).otherwise(0.0)
        .alias("average_precision"))


def all_metrics(scored: DataFrame, thresholds: Sequence[float], op: str = ">",
                by: Sequence[str] = ("task",)) -> DataFrame:
    """Threshold and rank metrics together."""
    return threshold_metrics(scored, thresholds, op, by).join(
        rank_metrics(scored, by), list(by))


def score_multiclass(predictions: DataFrame, thresholds: Sequence[float] = (0.5, 0.2),
                     by: Sequence[str] = ("fold",)) -> DataFrame:
    """All metrics of the three one-vs-rest tasks (strictly above the threshold)."""
    return all_metrics(one_vs_rest(predictions, by), thresholds, ">", (*by, "task"))


def get_scores(predictions: DataFrame, threshold: float,
               by: Sequence[str] = ("fold",)) -> DataFrame:
    """One wide row per group with ``{metric}_{task}`` columns."""
    return score_row(score_multiclass(predictions, [threshold], by), by)


def score_row(metrics: DataFrame, by: Sequence[str] = ("fold",),
              tasks: Sequence[str] = TASKS, names: Sequence[str] = METRICS) -> DataFrame:
    """Long metrics as one row per group (and threshold)."""
    columns = [F.max(F.when(F.col("task") == t, F.col(m))).alias(f"{m}_{t}")
               for t in tasks for m in names]
    return metrics.groupBy(*by, "threshold").agg(*columns)


def score_binary(scored: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of one probability column, at or above the threshold."""
    keyed = scored if by else scored.withColumn("task", F.lit("all"))
    return all_metrics(keyed, [threshold], ">=", tuple(by) or ("task",))


def score_multioutput(predictions: DataFrame, outputs: dict[str, tuple[str, str]],
                      threshold: float) -> DataFrame:
    """Metrics of several (label column, probability column) pairs, at or above the threshold."""
    rows = F.array(*[F.struct(F.lit(name).alias("task"), F.col(y).cast("int").alias("y"),
                              F.col(p).cast("double").alias("p"))
                     for name, (y, p) in outputs.items()])
    scored = predictions.select(F.explode(rows).alias("r")).select("r.*")
    return all_metrics(scored, [threshold], ">=", ("task",))


def youden_sweep(predictions: DataFrame, thresholds: Sequence[float], fold: int | None = 1,
                 task: str = "pasc_any") -> DataFrame:
    """Youden J of a task over thresholds, for one fold or (None) for every fold."""
    rows = predictions if fold is None else predictions.filter(F.col("fold") == fold)
    scored = one_vs_rest(rows, ("fold",)).filter(F.col("task") == task)
    return threshold_metrics(scored, thresholds, ">", ("fold", "task")).select(
        "fold", "threshold", "youden_j")
