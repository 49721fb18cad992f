from datetime import timedelta

from pyspark.sql import functions as F

from cohortloom.config import PhenotypeConfig
from cohortloom.operators import cohort as c
from cohortloom.sources.schemas import CDM_TABLES, RULES
from tests.conftest import day, rows

CFG = PhenotypeConfig()
PCR, AG, DX = CFG.pcr_concept, CFG.antigen_concept, CFG.diagnosis_concept
A, B, POS = CFG.diagnosis_a_value, CFG.diagnosis_b_value, 9191
MAX = day("2022-09-01")


def observations(spark, data):
    return spark.createDataFrame(
        [(p, v, day(d), concept, value, None) for p, v, d, concept, value in data],
        CDM_TABLES["observation_derivation"])


def test_base_cohort_labels_ties_and_cutoff(spark):
    obs = observations(spark, [
        (1, 10, "2021-01-05", DX, A),                                      # A only
        (2, 20, "2021-01-05", DX, B),                                      # B only
        (3, 30, "2021-01-05", DX, A), (3, 31, "2021-02-05", DX, B),         # both, A first
        (4, 40, "2021-01-05", PCR, POS), (4, 41, "2021-01-05", AG, POS),    # tie: antigen < pcr
        (5, 50, "2021-01-05", PCR, 9189),                                  # negative test
        (6, 60, "2022-09-01", PCR, POS),                                   # on the last day
        (7, 70, "2022-09-02", PCR, POS),                                   # after it
        (8, 80, "2020-12-01", PCR, POS), (8, 81, "2021-01-05", DX, A),      # test before diagnosis
        (9, 90, "2021-01-05", DX, A), (9, 91, "2021-01-05", DX, B),         # same-day A and B
        (10, None, "2021-01-05", PCR, None),                               # null value
    ])
    got = rows(c.base_cohort(obs, MAX, CFG), "person_id", "pasc_flag", "pasc_not_misc_flag",
               "observation_type", "index_visit_occurrence_id")
    assert got == [(1, 1, 1, "pasc", 10), (2, 1, 0, "misc", 20), (3, 1, 0, "pasc", 30),
                   (4, 0, 0, "antigen", 41), (6, 0, 0, "pcr", 60), (8, 1, 1, "pasc", 81),
                   (9, 1, 0, "misc", 91)]


def cohort_rows(spark, data):
    return spark.createDataFrame(
        [(p, flag, flag, day(d), "pasc" if flag else "pcr", 0) for p, flag, d in data],
        "person_id long, pasc_flag int, pasc_not_misc_flag int, index_date date, "
        "observation_type string, index_visit_occurrence_id long")


def test_code_adjust_precedence_and_strict_dates(spark):
    base = cohort_rows(spark, [(i, 0, "2021-03-01") for i in range(1, 8)]
                       + [(8, 1, "2021-03-01")])
    visits = spark.createDataFrame(
        [(1, 0, 0, day("2021-03-01")), (2, 0, 0, day("2021-04-01")),
         (3, 0, 0, day("2021-02-01")), (4, 0, 0, MAX), (5, 0, 0, day("2021-05-01"))],
        CDM_TABLES["visit_occurrence"])
    rules = spark.createDataFrame([(1, 11, "x", "pasc"), (2, 22, "y", "drop"),
                                   (3, 33, "z", "ignore")], RULES)
    conditions = spark.createDataFrame([
        (100, 1, 1, 1, 11, "x"),                            # on the index date: no
        (101, 2, 5, 1, 11, "x"), (102, 2, 2, 1, 11, "x"),    # switch at the earliest
        (103, 3, 2, 1, 11, "x"), (104, 3, 5, 2, 22, "y"),    # drop wins
        (105, 4, 2, 3, 33, "z"),                            # ignore
        (106, 5, 3, 1, 11, "x"),                            # before index
        (107, 6, 4, 1, 11, "x"),                            # on max_date: no
        (108, 7, 2, 1, 11, None),                           # null key never matches
        (109, 8, 2, 2, 22, "y"),                            # cases are not touched
    ], CDM_TABLES["condition_occurrence"])
    got = rows(c.code_adjust(base, conditions, visits, rules, MAX), "person_id", "pasc_flag",
               "observation_type", "index_date")
    control = [(i, 0, "pcr", day("2021-03-01")) for i in (1, 4, 5, 6, 7)]
    assert got == sorted(control + [(2, 1, "non_misc_pasc", day("2021-04-01")),
                                    (8, 1, "non_misc_pasc", day("2021-03-01"))])


def test_filter_visits_counts_distinct_later_days(spark):
    base = cohort_rows(spark, [(1, 0, "2021-03-01"), (2, 0, "2021-03-01"),
                               (3, 0, "2021-03-01")])
    visits = spark.createDataFrame(
        [(i, p, 0, day(d)) for i, (p, d) in enumerate([
            (1, "2021-03-02"), (1, "2021-03-05"), (2, "2021-03-02"), (2, "2021-03-02"),
            (3, "2021-03-01"), (3, "2021-03-04")])], CDM_TABLES["visit_occurrence"])
    assert rows(c.filter_visits(base, visits, 2), "person_id") == [(1,)]


def test_filter_dates_bounds(spark):
    base = cohort_rows(spark, [(1, 0, "2020-11-01"), (2, 0, "2020-10-31"),
                               (3, 0, "2022-07-31"), (4, 0, "2022-08-01")])
    got = rows(c.filter_dates(base, day("2020-11-01"), MAX), "person_id")
    assert got == [(1,), (3,)]


def test_impute_dates_range_and_reproducibility(spark):
    base = cohort_rows(spark, [(i, i % 2, "2021-06-01") for i in range(2000)])
    moved = c.impute_dates(base, -90, -28, 7)
    gaps = {r.person_id: (r.index_date - day("2021-06-01")).days for r in moved.collect()}
    cases = [g for p, g in gaps.items() if p % 2]
    assert all(g == 0 for p, g in gaps.items() if not p % 2)
    assert min(cases) == -90 and max(cases) == -28 and len(set(cases)) == 63
    again = c.impute_dates(base.repartition(5), -90, -28, 7)
    assert {r.person_id: (r.index_date - day("2021-06-01")).days
            for r in again.collect()} == gaps


def test_demo_age_sex_and_ethnicity(spark):
    base = cohort_rows(spark, [(i, 0, "2021-06-01") for i in range(1, 6)])
    adult = day("2021-06-01") - timedelta(days=int(21 * 365.25) + 1)
    teen = day("2021-06-01") - timedelta(days=int(21 * 365.25) - 1)
    person = spark.createDataFrame([
        (1, day("2015-01-01"), None, "s", 8507, 8527, 0),
        (2, day("2015-01-01"), None, "s", 8532, 8516, 38003563),
        (3, teen, None, "s", 0, 8557, 0), (4, adult, None, "s", 8507, 0, 0),
        (5, day("2022-01-01"), None, "s", None, 44814659, None)], CDM_TABLES["person"])
    got = rows(c.join_cohort_demo(base, person), "person_id", "entry_age", "sex_cat", "eth_cat")
    assert got == [(1, 6, "Male", "White"), (2, 6, "Female", "Hispanic"),
                   (3, 20, "Other/unknown", "Asian/PI"), (5, -1, "Other/unknown", "Multiple")]


def test_entry_periods(spark):
    dates = ["2020-03-15", "2021-02-28", "2021-03-01", "2021-10-31", "2022-02-01",
             "2022-07-31", "2022-08-01", "2019-12-31"]
    base = cohort_rows(spark, [(i, 0, d) for i, d in enumerate(dates)])
    got = rows(c.get_cohort_entry_period(base), "person_id", "cohort_entry_period")
    assert got == [(0, "nov_feb_21"), (1, "nov_feb_21"), (2, "mar_jun_21"), (3, "jul_oct_21"),
                   (4, "nov_feb_22"), (5, "mar_jul_22")]


def test_folds_are_balanced_complete_and_stable(spark):
    base = cohort_rows(spark, [(i, int(i % 10 == 0), "2021-06-01") for i in range(1003)])
    folded = c.split_cohort(base, 5, 11015)
    counts = {(r.pasc_flag, r.fold): r["count"]
              for r in folded.groupBy("pasc_flag", "fold").count().collect()}
    for flag in (0, 1):
        sizes = [counts[flag, f] for f in range(1, 6)]
        assert max(sizes) - min(sizes) <= 1
    assert folded.select("person_id").distinct().count() == 1003
    again = c.split_cohort(base.repartition(7), 5, 11015, prefix_digits=2)
    assert rows(folded, "person_id", "fold") == rows(again, "person_id", "fold")
    members = c.fold_memberships(folded, 5)
    assert members.count() == 5 * 1003
    assert members.filter("part = 'test'").count() == 1003


def test_split_probs(spark):
    base = cohort_rows(spark, [(1, 1, "2021-01-01"), (2, 0, "2021-01-01"),
                               (3, 0, "2022-08-31")]).withColumn("fold", F.col("person_id"))
    got = {r.split: (r.cases, r.persons) for r in c.split_probs(base, MAX, 6, 3).collect()}
    assert got == {"all": (1, 2), "1": (0, 1), "2": (1, 1), "3": (1, 2)}
