import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from cohortloom.config import CutThreshold
from cohortloom.functions.dates import since_index
from cohortloom.operators import audit, codesets, columns, deid, hierarchy
from cohortloom.sources import files
from cohortloom.sources.catalog import TableCatalog
from cohortloom.sources.schemas import RULES, SCAN, SCAN_HEADER
from tests.conftest import day, rows


@pytest.fixture()
def catalog(spark, tmp_path):
    return TableCatalog(spark, str(tmp_path / "cdm"), str(tmp_path / "vocab"),
                        str(tmp_path / "results"), aliases={"short": "long_name"},
                        results_tag="_v1", csv_folder=str(tmp_path / "csv"))


def test_names_tags_and_aliases(catalog):
    assert catalog.results_name("short").endswith("/results/long_name_v1")
    assert catalog.results_name("x_v1").endswith("/x_v1")
    assert catalog.intermed_name("x", results_tag=False) == "x"
    assert TableCatalog.qualify("db", "t") == "db.t"


def test_output_modes_existence_and_overwrite(spark, catalog, tmp_path):
    df = spark.range(3)
    assert not catalog.exists("t")
    catalog.output_tbl(df, "t")
    catalog.output_tbl(spark.range(5), "t")
    assert catalog.results_tbl("t").count() == 5
    catalog.remove("t")
    assert not catalog.exists("t")
    files_only = TableCatalog(spark, "", "", str(tmp_path / "r2"), mode="distribution",
                              csv_folder=str(tmp_path / "csv"))
    files_only.output_tbl(df, "t")
    assert not files_only.exists("t")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/t.csv")).count() == 3
    assert catalog.compute_new(df).count() == 3
    assert catalog.pull(df, "id", 10) == [0, 1, 2]
    with pytest.raises(ValueError):
        catalog.collect_new(df, limit=2)
    assert catalog.copy_to_new([(1, "a")], "loc", "i int, s string").first().s == "a"


def test_csv_quotes_nulls_and_types(spark, tmp_path):
    data = [(1, 2, 'text, with "quotes"|B94.8', "pasc"), (3, None, None, "drop")]
    path = str(tmp_path / "rules")
    files.write_csv(spark.createDataFrame(data, RULES), path)
    back = files.read_rules(spark, path)
    assert back.schema == RULES and rows(back) == sorted(data)


def test_scan_headers(spark, tmp_path):
    path = str(tmp_path / "scan")
    files.write_csv(spark.createDataFrame([(1, 5, 4, 1.5, 9.5, 2000, 3.5, None)], SCAN)
                    .toDF(*SCAN_HEADER), path)
    got = files.read_scans(spark, {"all": path, "1": path})
    assert got.columns == [f.name for f in SCAN.fields] + ["split"]
    assert rows(got, "split", "node_identifier", "p_value") == [("1", 5, None),
                                                               ("all", 5, None)]


def test_codeset_types_and_registration(spark, tmp_path):
    path = str(tmp_path / "codes")
    files.write_csv(spark.createDataFrame([(7, "n", "c", "v")], "concept_id long, concept_name "
                    "string, concept_code string, vocabulary_id string"), path)
    codes = codesets.load_codeset(spark, path, "my_codes", "iccc")
    assert spark.table("my_codes").count() == 1 and codes.schema[0].dataType.typeName() == "long"
    with pytest.raises(ValueError):
        codesets.read_codeset(spark, path, "ic")


def test_process_codes_from_file_writes_both(spark, tmp_path):
    concept = spark.createDataFrame([(1, "n", "S1", "ICD10CM", "d", "k", None),
                                     (2, "std", "X", "SNOMED", "d", "k", None)],
                                    "concept_id long, concept_name string, concept_code string, "
                                    "vocabulary_id string, domain_id string, "
                                    "concept_class_id string, invalid_reason string")
    relation = spark.createDataFrame([(1, 2, "Maps to", None)],
                                     "concept_id_1 long, concept_id_2 long, "
                                     "relationship_id string, invalid_reason string")
    source = str(tmp_path / "codes.csv")
    files.write_csv(spark.createDataFrame([("S1", "one (ICD10CM)")],
                                          "code string, description string"), source)
    codesets.process_codes_from_file(spark, source, concept, relation)
    mapped = str(tmp_path / "codes_mapped.csv")
    closure = spark.createDataFrame([(2, 2, 0)], "ancestor_concept_id long, "
                                    "descendant_concept_id long, min_levels_of_separation int")
    merged, final = codesets.merge_sets_from_files(spark, [mapped, mapped], concept, closure)
    assert rows(final, "concept_id", "concept_name") == [(2, "std")]


def test_ages_nonce_ids_and_site(spark):
    person = spark.createDataFrame(
        [(5, dt.datetime(2010, 1, 1, 12), "s1"), (9, dt.datetime(2010, 1, 2), "s2")],
        "person_id long, birth_datetime timestamp, site string")
    data = spark.createDataFrame(
        [(9, day("2010-01-12"), None, "x", None), (5, day("2010-01-02"), day("2010-01-03"), "y",
                                                   None)],
        "person_id long, index_date date, end_date date, end_datetime string, a_time string")
    ages = deid.dates_to_ages(data, person)
    assert ages.columns == ["person_id", "index_age", "end_age"]
    assert rows(ages) == [(5, 1, 2), (9, 10, None)]
    scrubbed = deid.scrub_person_info(data, person)
    assert rows(scrubbed, "person_id", "index_age") == [(1, 1), (2, 10)]
    born = data.selectExpr("person_id", "index_date AS birth_date", "index_date")
    assert deid.dates_to_ages(born, person).columns == ["person_id", "index_age"]
    bare = data.select("person_id")
    assert deid.dates_to_ages(bare, person) is bare
    assert rows(deid.add_site(bare, person)) == [(5, "s1"), (9, "s2")]
    assert rows(deid.add_site(bare, person.drop("site"), default="here"), "site")[0] == ("here",)
    assert deid.distinct_ct(spark.createDataFrame([(1,), (1,), (None,)], "person_id long")
                            ).first().dist_ct == 2


def test_column_rules(spark):
    df = spark.createDataFrame([(1, None, 3)], "person_id int, std_a int, std_b int")
    assert columns.rename_matching(df, "^std_", "").columns == ["person_id", "a", "b"]
    assert columns.drop_matching(df, "_a$").columns == ["person_id", "std_b"]
    assert columns.fill_zero(df, ["person_id"]).first().std_a == 0
    assert columns.mutate_matching(df, "_b$", lambda c: c + 1).first().std_b == 4


def test_step_log(spark):
    log = audit.StepLog(spark, "here").init_sum(cohort="Start", persons=0)
    log.append_sum(cohort="Two", persons=spark.createDataFrame([(1,), (1,), (2,)],
                                                               "person_id long"))
    assert rows(log.frame(), "step_number", "cohort", "persons", "rows", "site") == [
        (1, "Start", 0, None, "here"), (2, "Two", 2, 3, "here")]


def test_observed_steps_are_counted_by_the_pass_that_writes(spark, tmp_path):
    catalog = TableCatalog(spark, "", "", str(tmp_path))
    log = audit.StepLog(spark, "here")
    events = spark.range(1000).selectExpr("id % 300 as person_id")
    seen = log.observed(events, "person_id", step="events").distinct()
    catalog.compute_new(log.observed(seen, step="persons").filter("person_id < 10"), "kept")
    log.append_sum(persons=5, step="given")
    got = {r.step: r for r in log.output_sum(catalog).collect()}
    assert got["events"].rows == 1000 and abs(got["events"].persons - 300) <= 12
    assert (got["persons"].persons, got["persons"].rows) == (300, 300)
    assert got["given"].persons == 5 and catalog.exists("here_steps")
    assert [got[s].step_number for s in ("events", "persons", "given")] == [1, 2, 3]
    user, system, elapsed = map(float, got["events"].used.split(";"))
    assert user >= 0 and system >= 0 and elapsed > 0


def test_bucketed_tables_join_by_person_without_an_exchange(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS by_person")
    catalog = TableCatalog(spark, "by_person", "by_person", "by_person", buckets=8)
    visits = spark.range(900).selectExpr("id % 70 as person_id", "id as visit_occurrence_id",
                                         "date_add(date'2021-01-01', cast(id % 400 as int)) as visit_start_date")
    members = spark.range(50).selectExpr("id as person_id", "date'2021-06-01' as index_date")
    plain = visits.join(members, "person_id")
    events = catalog.bucketed(visits, "visit_occurrence", "by_person", sort_by=["visit_start_date"])
    cohort = catalog.bucketed(members, "cohort")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = catalog.cdm_tbl("visit_occurrence").join(catalog.results_tbl("cohort"), "person_id")
        joined = joined.filter(since_index("visit_start_date", "index_date", 28))
        counted = joined.groupBy("person_id").agg(F.count("*").alias("n"))
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert rows(counted) == rows(plain.filter(since_index("visit_start_date", "index_date", 28))
                                     .groupBy("person_id").agg(F.count("*").alias("n")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        catalog.remove("cohort")
        catalog.remove("visit_occurrence")
        spark.sql("DROP DATABASE by_person")
    assert events.columns == visits.columns and cohort.columns == members.columns
    with pytest.raises(ValueError):
        TableCatalog(spark, "", "", str(tmp_path)).bucketed(members, "cohort")


def test_the_best_cuts_of_each_group(spark):
    rng = random.Random(4)
    scan = [(d, n, rng.choice([1.0, 2.5, 7.0]), 3, 50, rng.choice([0.001, 0.5, None]))
            for d in ("a", "b", None) for n in range(40)]
    scan = spark.createDataFrame(scan, "domain string, node_identifier int, log_likelihood_ratio double, "
                                       "tree_level int, observations int, p_value double").repartition(4)
    nodes = spark.createDataFrame([(n, f"node {n}") for n in range(0, 40, 2)], "node_concept_id int, node_concept string")
    rule = CutThreshold(3, 1)
    every = hierarchy.select_cuts(scan, nodes, rule, ["domain"])
    best = hierarchy.select_cuts(scan, nodes, rule, ["domain"], k=4)
    assert rows(best) == rows(every.filter("cut_rank <= 4"))
    want = sorted((-r.log_likelihood_ratio, r.node_identifier) for r in scan.collect()
                  if r.domain == "a" and r.p_value == 0.001)
    got = every.filter("domain = 'a'").orderBy("cut_rank").collect()
    assert [(-r.log_likelihood_ratio, r.node_identifier) for r in got] == want
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
