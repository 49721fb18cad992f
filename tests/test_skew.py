"""One person holds a third of all rows: joins are split and results stay whole."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.ml.classification import LogisticRegression

from cohortloom.config import DOMAINS, PhenotypeConfig
from cohortloom.functions.distributed import stored
from cohortloom.operators import assemble, events, hierarchy, train, windows
from tests.conftest import day, rows

ROWS, HOT = 300_000, 0


@pytest.fixture()
def splitting(spark):
    """Settings under which small data already counts as skewed."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
             "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def inputs(spark):
    person = F.when(F.col("id") % 3 == 0, HOT).otherwise(F.col("id") % 5000)
    visits = spark.range(0, ROWS, 1, 12).select(
        F.col("id").alias("visit_occurrence_id"), person.cast("long").alias("person_id"),
        F.lit(9203).cast("long").alias("visit_concept_id"),
        F.date_add(F.lit(day("2021-01-01")), (F.col("id") % 400).cast("int"))
        .alias("visit_start_date"))
    cohort = spark.range(5000).select(
        F.col("id").alias("person_id"), F.lit(day("2021-03-01")).alias("index_date"),
        F.lit("pcr").alias("observation_type"), (F.col("id") % 2).cast("int").alias("pasc_flag"))
    return visits, cohort


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_person_join_is_split_and_complete(splitting):
    visits, cohort = inputs(splitting)
    adt = splitting.createDataFrame([], "visit_occurrence_id long, service_concept_id long")
    util = events.get_util(cohort, visits, adt, -28, PhenotypeConfig())
    long = windows.util_long(util, ids=windows.COHORT_IDS)
    got = long.groupBy("person_id").agg(F.sum("value").alias("days")).collect()
    days = {r.person_id: r.days for r in got}
    # Day numbers 31 to 238 lie in the windows; the hot person is seen on every third row.
    assert days[HOT] == len({i % 400 for i in range(0, 1200, 3)} & set(range(31, 239)))
    plain = (visits.join(F.broadcast(cohort), "person_id")
             .filter("visit_start_date >= date_add(index_date, -28) "
                     "AND visit_start_date < date_add(index_date, 180)")
             .groupBy("person_id").agg(F.countDistinct("visit_start_date").alias("days")))
    assert {r.person_id: r.days for r in plain.collect()} == days
    joined = visits.join(cohort, "person_id")
    joined.write.format("noop").mode("overwrite").save()
    joined.collect()
    assert "skew" in final_plan(joined).lower()


def test_hot_concept_is_counted_whole(splitting):
    visits, cohort = inputs(splitting)
    tree = splitting.createDataFrame([(1, "top", 7, "hot"), (1, "top", 8, "cold")],
                                     "ancestor_concept_id long, ancestor_concept_name string, "
                                     "descendant_concept_id long, descendant_concept_name string")
    conditions = visits.select(
        "person_id", "visit_occurrence_id",
        F.when(F.col("visit_occurrence_id") % 10 < 9, 7).otherwise(8).cast("long")
        .alias("condition_concept_id"))
    got = hierarchy.node_counts(tree, cohort, conditions, visits, DOMAINS["cond"], -28, 6,
                                day("2022-09-01"))
    brute = (conditions.join(visits.drop("person_id"), "visit_occurrence_id")
             .filter("visit_start_date >= '2021-02-01' AND visit_start_date < '2021-09-01'")
             .groupBy("condition_concept_id").agg(F.countDistinct("person_id")))
    assert rows(got, "node", "pop_count") == rows(brute)


def test_drop_diff_and_model_score(spark):
    data = [(i, "cond", f"k{i % 3}", 1.0) for i in range(30)] + [(31, "cond", "only", 1.0)]
    train_rows = spark.createDataFrame(
        data, "person_id long, domain string, feature_key string, value double")
    test_rows = train_rows.filter("feature_key <> 'k2'").unionByName(
        spark.createDataFrame([(40, "cond", "new", 1.0)], train_rows.schema)).filter(
        "feature_key <> 'only'")
    a, b = assemble.drop_diff(train_rows, test_rows)
    assert {r.feature_key for r in a.collect()} == {r.feature_key for r in b.collect()} == {
        "k0", "k1"}
    cohort = spark.range(30).select(F.col("id").alias("person_id"),
                                    (F.col("id") % 3 == 0).cast("double").alias("label"))
    vectors = assemble.feature_vectors(cohort, train_rows, *assemble.vector_layout(train_rows))
    seen = Observation("a session that has observed something")
    cohort.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == cohort.count()
    score = train.model_score(LogisticRegression(), vectors, vectors).first()
    assert score.auroc == 1.0 and score.accuracy == 1.0
    table = train.model_eval(LogisticRegression(), vectors, {"regParam": [0.0, 5.0]}, folds=2)
    assert table.count() == 2 * 2 * 6
    assert table.filter("best").select("params").distinct().count() == 1
    assert table.filter("value < 0 or value > 1").count() == 0


def test_events_without_an_id_stay_out_of_the_guard_join(splitting):
    spark, cfg = splitting, PhenotypeConfig()
    rows_in = spark.range(2000).select(
        F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("event_id"),
        F.lit(5).cast("long").alias("ancestor_concept_id"))
    source = F.when(F.col("id") < 100, F.col("id").cast("string"))
    obs = spark.range(200).select(
        F.lit(cfg.diagnosis_concept).cast("long").alias("observation_concept_id"),
        F.lit(cfg.diagnosis_values[0]).cast("long").alias("value_as_concept_id"),
        source.alias("observation_source_concept_id"))
    rows_in = stored(rows_in)
    kept = events.remove_label_events(rows_in, obs, DOMAINS["cond"].__class__(
        "one", "events", "concept_id", (), "", "event_id"), cfg)
    assert kept.count() == 2000 - 10
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("LeftAnti"):].splitlines()[1:3]
    assert any("isnotnull(event_id" in line for line in below)


def test_a_frequent_concept_meets_features_once_a_day(spark):
    """Many events of one concept, person and day are one row before the feature join."""
    people = spark.range(4).select(F.col("id").alias("person_id"),
                                   F.lit(day("2021-03-01")).alias("index_date"))
    visits = spark.range(4).select(F.col("id").alias("visit_occurrence_id"),
                                   F.lit(day("2021-03-05")).alias("visit_start_date"))
    many = spark.range(4000).select(
        (F.col("id") % 4).alias("person_id"), (F.col("id") % 4).alias("visit_occurrence_id"),
        F.lit(7).cast("long").alias("measurement_concept_id"))
    features = spark.createDataFrame([(7, 1), (7, 2)],
                                     "descendant_concept_id long, ancestor_concept_id long")
    days = events.guarded_feature_days(people, features, many, visits, None, DOMAINS["lab"], -28)
    assert rows(days, "person_id", "ancestor_concept_id") == [
        (p, a) for p in range(4) for a in (1, 2)]
