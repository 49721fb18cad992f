import random

import pytest

from cohortloom.functions import labels
from cohortloom.functions.distributed import row_numbers, running_sums
from cohortloom.operators import assemble, metrics
from pyspark.sql import functions as F
from tests.conftest import rows


def scored(spark, data):
    return spark.createDataFrame([("t", y, float(p)) for y, p in data],
                                 "task string, y int, p double")


def brute(data):
    """AUROC by pairs and average precision by the definition."""
    pos = [p for y, p in data if y]
    neg = [p for y, p in data if not y]
    auroc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = last = 0.0
    for t in sorted({p for _, p in data}, reverse=True):
        tp = sum(y for y, p in data if p >= t)
        recall = tp / len(pos)
        ap += (recall - last) * tp / sum(p >= t for _, p in data)
        last = recall
    return auroc, ap


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rank_metrics_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(int(rng.random() < 0.3), round(rng.random(), 1 + seed % 2)) for _ in range(300)]
    got = metrics.rank_metrics(scored(spark, data)).first()
    auroc, ap = brute(data)
    assert got.auroc == pytest.approx(auroc) and got.average_precision == pytest.approx(ap)


def test_single_class_and_no_predicted_positive(spark):
    assert metrics.rank_metrics(scored(spark, [(1, 0.2), (1, 0.3)])).first().auroc is None
    got = metrics.threshold_metrics(scored(spark, [(1, 0.2), (0, 0.5)]), [0.5]).first()
    assert (got.precision, got.recall, got.specificity, got.f1) == (0, 0, 1, 0)
    at_least = metrics.threshold_metrics(scored(spark, [(1, 0.2), (0, 0.5)]), [0.5], ">=").first()
    assert at_least.specificity == 0


def test_one_vs_rest_tasks(spark):
    rows_ = spark.createDataFrame([(1, 0, 0.5, 0.3, 0.2), (2, 1, 0.2, 0.5, 0.3),
                                   (3, 2, 0.1, 0.1, 0.8)],
                                  "person_id long, y3 int, p0 double, p1 double, p2 double")
    got = {(r.task, r.y, round(r.p, 6)) for r in metrics.one_vs_rest(rows_).collect()}
    assert ("pasc_any", 1, 0.8) in got and ("misc", 1, 0.5) in got
    assert ("non_misc", 1, 0.8) in got and ("misc", 0, 0.1) in got and len(got) == 9


def test_row_numbers_and_running_sums_across_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5000)
                                  .alias("k"), F.lit(1).alias("one")).repartition(16)
    numbered = row_numbers(df, [F.asc("k")], "n")
    assert rows(numbered, "n") == [(i,) for i in range(1, 5001)]
    assert numbered.filter("n <> k + 1").count() == 0
    grouped = row_numbers(df, [F.desc("k")], "n", by=["g"])
    top = grouped.groupBy("g").agg(F.min("n"), F.max("n"), F.countDistinct("n"), F.count("*"))
    for _, low, high, distinct, count in top.collect():
        assert (low, high) == (1, count) and distinct == count
    sums = running_sums(df, [F.asc("k")], ["one"], ["g"])
    assert sums.groupBy("g").agg((F.max("cum_one") == F.count("*")).alias("ok")).filter(
        "NOT ok").count() == 0


def test_scaling_uses_all_persons_and_population_deviation(spark):
    persons = spark.range(4).withColumnRenamed("id", "person_id")
    long = spark.createDataFrame([(0, "a", 2.0), (1, "a", 4.0), (0, "b", 1.0), (1, "b", 1.0),
                                  (2, "b", 1.0), (3, "b", 1.0)],
                                 "person_id long, feature_key string, value double")
    stats = {r.feature_key: r for r in assemble.feature_stats(long, persons).collect()}
    values = [2, 4, 0, 0]
    mean = sum(values) / 4
    sd = (sum((v - mean) ** 2 for v in values) / 4) ** 0.5
    assert stats["a"].mean == mean and stats["a"].sd == pytest.approx(sd)
    assert stats["a"].zero_value == pytest.approx(-mean / sd)
    assert stats["b"].sd == 1.0
    scaled = assemble.scale(long, assemble.feature_stats(long, persons))
    assert {round(r.value, 9) for r in scaled.filter("feature_key = 'b'").collect()} == {0.0}


def test_vectors_hold_flags_counts_and_empty_persons(spark):
    cohort = spark.createDataFrame([(1, 0.0, 1), (2, 2.0, 2), (3, 1.0, 1)],
                                   "person_id long, label double, fold int")
    long = spark.createDataFrame(
        [(1, "cond", "w_1", 1.0), (1, "util", "ED_w", 3.0), (2, "cond", "w_2", 1.0),
         (9, "cond", "w_1", 1.0)],
        "person_id long, domain string, feature_key string, value double")
    flags, counts = assemble.vector_layout(long)
    assert (flags, counts) == (["w_1", "w_2"], ["ED_w"])
    got = {r.person_id: (r.label, r.fold, r.features.toArray().tolist())
           for r in assemble.feature_vectors(cohort, long, flags, counts).collect()}
    assert got == {1: (0.0, 1, [1, 0, 3]), 2: (2.0, 2, [0, 1, 0]), 3: (1.0, 1, [0, 0, 0])}


def test_labels(spark):
    def one(expr_fn, text):
        return spark.range(1).select(expr_fn(F.lit(text)).alias("x")).first().x

    assert one(labels.label_cond, "-1m_to_0m_Fever, high, 12") == "Fever (-1 to 0 m)"
    assert one(labels.label_cond, "3m_to_6m_Cough, 12") == "Cough (3 to 6 m)"
    assert one(labels.label_drug, "0m_to_1m_x_big PILL, 3") == "Big pill (0 to 1 m)"
    assert one(labels.label_util, "ED_ICU_-1m_to_0m") == "ED ICU visits (-1 to 0 m)"
    assert one(labels.label_util, "Other/Unknown_2m_to_3m") == "Other/Unknown visits (2 to 3 m)"
    assert one(labels.label_lab_cts, "1m_to_2m") == "Lab count (1 to 2 m)"
    assert one(labels.label_demo, "eth_White") == "Race/ethnicity: NH White"
    assert one(lambda k: labels.label_demo(k, {"x": "Site A"}), "site_x") == "Site A"
