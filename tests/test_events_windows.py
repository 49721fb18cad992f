from datetime import timedelta

from cohortloom.config import DOMAINS, STACKED, PhenotypeConfig
from cohortloom.operators import events as e
from cohortloom.operators import windows as w
from cohortloom.sources.schemas import CDM_TABLES
from tests.conftest import day, rows

CFG = PhenotypeConfig()
INDEX = day("2021-06-01")
OFFSETS = [-29, -28, -1, 0, 29, 30, 59, 60, 89, 90, 179, 180]


def cohort(spark, persons=(1, 2)):
    return spark.createDataFrame([(p, INDEX, "pcr", 0) for p in persons],
                                 "person_id long, index_date date, observation_type string, "
                                 "pasc_flag int")


def visits(spark, offsets=OFFSETS, person=1, concept=9203):
    data = [(i, person, concept, INDEX + timedelta(days=o)) for i, o in enumerate(offsets)]
    return spark.createDataFrame(data + [(99, person, concept, None)],
                                 CDM_TABLES["visit_occurrence"])


def test_window_edges(spark):
    dated = visits(spark).join(cohort(spark), "person_id")
    got = {(r.visit_start_date - INDEX).days: r.window
           for r in w.assign_window(dated, "visit_start_date").collect()}
    assert got == {-29: "-1m_to_0m", -28: "-1m_to_0m", -1: "-1m_to_0m", 0: "0m_to_1m",
                   29: "0m_to_1m", 30: "1m_to_2m", 59: "1m_to_2m", 60: "2m_to_3m",
                   89: "2m_to_3m", 90: "3m_to_6m", 179: "3m_to_6m"}


def test_util_counts_days_and_fills_zero(spark):
    adt = spark.createDataFrame([(0, 2000000079), (1, 2000000079), (1, 2000000080), (3, 5)],
                                CDM_TABLES["adt_occurrence"])
    found = e.get_util(cohort(spark), visits(spark), adt, -28, CFG)
    assert found.count() == len(OFFSETS) - 1  # day -29 and the null date are out
    wide = w.make_util_tbl(cohort(spark), found).orderBy("person_id").collect()
    one, two = wide
    assert len(wide) == 2 and len(wide[0]) == 3 + 35
    assert one["ED_ICU_-1m_to_0m"] == 1 and one["ED_non_ICU_-1m_to_0m"] == 1
    assert one["ED_non_ICU_0m_to_1m"] == 2 and one["ED_non_ICU_3m_to_6m"] == 2
    assert sum(v for k, v in two.asDict().items() if "_to_" in k) == 0
    flat = w.make_util_tbl(cohort(spark), found, False, 27, 180).orderBy("person_id").first()
    assert flat["ED_non_ICU"] == 7  # offsets 29 to 179: both bounds are strict


def test_visit_location_unknown_icu(spark):
    clusters = spark.createDataFrame([(7, "c")], "concept_id long, cluster string")
    conditions = spark.createDataFrame([(1, 1, 3, 7, 7, "t"), (2, 1, 4, 7, 7, "t")],
                                       CDM_TABLES["condition_occurrence"])
    adt = spark.createDataFrame([(3, 2000000078)], CDM_TABLES["adt_occurrence"])
    got = e.get_cluster_visits_alt(cohort(spark), clusters, conditions,
                                   visits(spark, concept=5), adt, 0, CFG)
    assert rows(got, "visit_occurrence_id", "visit_loc") == [
        (3, "ICU Unknown"), (4, "Other/Unknown")]


def features(spark, domain=None):
    data = [(900, "n900", 7, "n7"), (901, "n901", 7, "n7"), (444201, "leak", 8, "n8")]
    df = spark.createDataFrame(data, "ancestor_concept_id long, ancestor_concept string, "
                                     "descendant_concept_id long, descendant_concept string")
    return df if domain is None else df.selectExpr(f"'{domain}' AS domain", "*")


def guard_inputs(spark):
    conditions = spark.createDataFrame(
        [(1, 1, 3, 7, 7, "t"), (2, 1, 5, 7, 7, "t"), (3, 1, 3, 8, 8, "t"), (4, 1, 0, 7, 7, "t")],
        CDM_TABLES["condition_occurrence"])
    obs = spark.createDataFrame(
        [(1, 5, INDEX, CFG.diagnosis_concept, CFG.diagnosis_a_value, 2)],
        CDM_TABLES["observation_derivation"])
    return conditions, obs


def test_feature_fan_out_and_leak_guard(spark):
    conditions, obs = guard_inputs(spark)
    found = e.feature_events(cohort(spark), features(spark), conditions, visits(spark),
                             DOMAINS["cond"], -28)
    # Event 4 is a day too early; event 3 has the leak feature; 1 and 2 fan out.
    assert rows(found, "condition_occurrence_id", "ancestor_concept_id") == [
        (1, 900), (1, 901), (2, 900), (2, 901), (3, 444201)]
    safe = e.remove_label_events(found, obs, DOMAINS["cond"], CFG)
    assert rows(safe, "condition_occurrence_id", "ancestor_concept_id") == [(1, 900), (1, 901)]


def test_wide_features_keep_members_without_events(spark):
    conditions, obs = guard_inputs(spark)
    wide = w.make_feature_tbl(cohort(spark), "cond", features(spark), conditions, visits(spark),
                              obs, ["0m_to_1m_900", "0m_to_1m_901"], -28)
    assert wide.columns[3:] == ["0m_to_1m_900", "0m_to_1m_901"]
    assert rows(wide, "person_id", "0m_to_1m_900") == [(1, 1), (2, 0)]
    assert sum(r[1] for r in rows(wide, "person_id", "0m_to_1m_901")) == 1


def test_pivot_takes_lists_of_any_length(spark):
    long = w.presence_flags(
        visits(spark).join(cohort(spark), "person_id"), "visit_start_date",
        "visit_occurrence_id", ids=w.COHORT_IDS)
    keys = [f"k{i}" for i in range(2500)] + ["0m_to_1m_3", "0m_to_1m_4"]
    wide = w.to_wide(long, w.COHORT_IDS, keys, cohort(spark))
    assert rows(wide, "person_id", "0m_to_1m_3", "k5") == [(1, 1, 0), (2, 0, 0)]


def test_stacked_features_equal_single_domain(spark):
    conditions, obs = guard_inputs(spark)
    one = w.feature_long(cohort(spark), "cond", features(spark), conditions, visits(spark), obs,
                         -28, cfg=CFG)
    labs = spark.createDataFrame([(1, 4, 7)], CDM_TABLES["measurement_labs"])
    stacked = e.stack_events({"cond": conditions, "lab": labs})
    both = w.feature_long(cohort(spark), STACKED, features(spark, "cond"), stacked,
                          visits(spark), obs, -28, cfg=CFG)
    assert rows(both.drop("domain")) == rows(one)
    assert rows(both, "domain")[0] == ("cond",)


def test_lab_counts_sum_distinct_days_per_lab(spark):
    labs = spark.createDataFrame([(1, 3, 7), (1, 3, 7), (1, 3, 8), (1, 4, 7), (1, 3, None)],
                                 CDM_TABLES["measurement_labs"])
    found = e.get_lab_cts(cohort(spark), labs, visits(spark), -28)
    wide = w.make_lab_count_tbl(cohort(spark), found)
    assert rows(wide, "person_id", "0m_to_1m", "3m_to_6m") == [(1, 4, 0), (2, 0, 0)]
    assert rows(w.partition_dates_and_pivot_wide_lab_cts(found, False, -28, 180),
                "person_id", "n_labs") == [(1, 4)]


def test_lookback_bounds_and_default_column(spark):
    index = cohort(spark).selectExpr("person_id", "index_date AS cohort_start_date")
    back = [-366, -365, 0, 1]
    got = e.lookback_facts(visits(spark, back), index, table_name="VISIT_OCCURRENCE")
    assert sorted((r.visit_start_date - INDEX).days for r in got.collect()) == [-365, 0]
    assert "cohort_start_date" not in got.columns


def test_cluster_guard_drops_null_text_and_acting_rules(spark):
    clusters = spark.createDataFrame([(7, "c"), (8, "pasc")], "concept_id long, cluster string")
    conditions = spark.createDataFrame(
        [(1, 1, 10, 7, 7, "fine"), (2, 1, 10, 7, 7, None), (3, 1, 10, 7, 7, "Post-COVID x"),
         (4, 1, 10, 7, 7, "rule"), (5, 1, 10, 8, 8, "fine"), (6, 1, 10, 7, 7, "ignored")],
        CDM_TABLES["condition_occurrence"])
    rules = spark.createDataFrame([(7, 7, "rule", "drop"), (7, 7, "ignored", "ignore")],
                                  "condition_concept_id long, condition_source_concept_id long, "
                                  "condition_source_value string, action string")
    _, obs = guard_inputs(spark)
    hits = e.get_cluster_visits(cohort(spark), clusters, conditions, visits(spark), 28)
    assert rows(hits, "condition_occurrence_id") == [(1,), (2,), (3,), (4,), (6,)]
    safe = e.remove_label_cluster_events(hits, obs, rules, CFG)
    assert rows(safe, "condition_occurrence_id") == [(1,), (6,)]


def test_drugs_dated_by_exposure_and_fan_out(spark):
    concept = spark.createDataFrame(
        [(1, "ing1", "a", "RxNorm", "Drug", "Ingredient", None),
         (2, "ing2", "b", "RxNorm", "Drug", "Ingredient", None),
         (3, "pill", "c", "RxNorm", "Drug", "Clinical Drug", None)],
        "concept_id long, concept_name string, concept_code string, vocabulary_id string, "
        "domain_id string, concept_class_id string, invalid_reason string")
    closure = spark.createDataFrame([(1, 3, 1), (2, 3, 1), (1, 1, 0), (3, 3, 0)],
                                    "ancestor_concept_id long, descendant_concept_id long, "
                                    "min_levels_of_separation int")
    drugs = spark.createDataFrame([(1, 0, 3, INDEX + timedelta(days=28)),
                                   (1, 0, 3, INDEX + timedelta(days=27))],
                                  CDM_TABLES["drug_exposure"])
    got = e.get_drugs(cohort(spark), drugs, concept, closure, 28)
    assert rows(got, "person_id", "concept_name") == [(1, "ing1"), (1, "ing2")]
