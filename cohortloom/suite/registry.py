"""Registered queries: name -> (Spark query, SQL or None)."""

from __future__ import annotations

from dataclasses import replace
from typing import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.config import DOMAINS, STACKED, UTIL_LOCATIONS, WINDOWS
from cohortloom.functions import labels
from cohortloom.functions.distributed import stored, union_all, work_path
from cohortloom.operators import (assemble, audit, boosting, codesets, cohort, deid, events,
                                  hierarchy, metrics, train, wide, windows)
from cohortloom.plans import study as plans
from cohortloom.sources import files, schemas
from cohortloom.sources.catalog import TableCatalog
from cohortloom.sources.star_mapping import (BRANDS, PROMO_NODE, STAR_CONFIG, TYPES, group_id_of)
from cohortloom.suite.oracle_views import MAX_DATE, months, window_case, with_views
from cohortloom.suite.study import Study

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

COHORT = ("person_id, pasc_flag, pasc_not_misc_flag, index_date, observation_type, "
          "index_visit_occurrence_id")
DEMO = f"{COHORT}, birth_date, site, entry_age, sex_cat, eth_cat"
STUDY = f"{DEMO}, index_month, index_year, cohort_entry_period"
IDS = "person_id, index_date, observation_type, pasc_flag"


def query(name: str, sql: str | None = None):
    """Register a function of a Study under a name, with its SQL counterpart."""
    def register(fn: Callable[[Study], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Study(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return register


def _columns(text: str) -> list[str]:
    return [c.strip() for c in text.split(",")]


def _csv_round_trip(study: Study, df: DataFrame, read) -> DataFrame:
    """Write a frame as CSV into the shared folder and read it back through a typed source."""
    path = work_path(study.spark, "csv")
    files.write_csv(df, path)
    return read(path)


# Sources -------------------------------------------------------------------------------

@query("codeset_join", """
SELECT s.concept_id, s.concept_name, s.concept_code, s.vocabulary_id, count(*) AS events
FROM codeset s JOIN closure k ON k.ancestor_concept_id = s.concept_id
JOIN conditions e ON e.condition_concept_id = k.descendant_concept_id GROUP BY ALL""")
def codeset_join(s: Study) -> DataFrame:
    codes = _csv_round_trip(s, s.cdm.codeset(), lambda p: codesets.read_codeset(s.spark, p))
    below = s.cdm.concept_ancestor.join(
        codes.withColumnRenamed("concept_id", "ancestor_concept_id"), "ancestor_concept_id")
    hits = s.cdm.conditions.select("condition_concept_id").join(
        below.withColumnRenamed("descendant_concept_id", "condition_concept_id"),
        "condition_concept_id")
    return (hits.groupBy(F.col("ancestor_concept_id").alias("concept_id"), "concept_name",
                         "concept_code", "vocabulary_id")
            .agg(F.count("*").alias("events")))


@query("load_codeset", "SELECT concept_id, concept_name, concept_code, vocabulary_id FROM codeset")
def load_codeset(s: Study) -> DataFrame:
    return _csv_round_trip(s, s.cdm.codeset(),
                           lambda p: codesets.load_codeset(s.spark, p, "type_groups"))


@query("catalog_table", f"SELECT {COHORT} FROM base_cohort")
def catalog_table(s: Study) -> DataFrame:
    """A result written, found and read back through the catalog."""
    catalog = TableCatalog(s.spark, "", "", work_path(s.spark, "results"))
    catalog.output_tbl(s.base_cohort.select(*_columns(COHORT)), "cohort")
    if not catalog.exists("cohort"):
        raise RuntimeError("the result was not written")
    return catalog.results_tbl("cohort")


@query("rules_join", """
SELECT r.action, count(*) AS events, count(DISTINCT e.person_id) AS persons
FROM conditions e JOIN rules r ON r.condition_concept_id = e.condition_concept_id
  AND r.condition_source_concept_id = e.condition_source_concept_id
  AND r.condition_source_value = e.condition_source_value GROUP BY r.action""")
def rules_join(s: Study) -> DataFrame:
    rules = _csv_round_trip(s, s.cdm.rules, lambda p: files.read_rules(s.spark, p))
    return cohort.rule_events(s.cdm.conditions, rules).groupBy("action").agg(
        F.count("*").alias("events"), F.countDistinct("person_id").alias("persons"))


@query("scan_files", " UNION ALL ".join(f"""
SELECT '{d}' AS domain, {split} AS split, cut_no, node_identifier, tree_level, relative_risk,
       log_likelihood_ratio, observations, expected, p_value FROM {view}_{d}"""
    for d in DOMAINS for split, view in (("'all'", "scan"), ("fold::VARCHAR", "scan_fold"))))
def scan_files(s: Study) -> DataFrame:
    """Scan files of every domain, of the whole cohort and of every training set."""
    columns = [f.name for f in schemas.SCAN.fields]
    whole, folds = stored(s.scan(STACKED.name)), stored(s.fold_scan(STACKED.name))
    out = []
    for d in DOMAINS:
        paths = {}
        for split in ("all", *map(str, range(1, s.cfg.folds + 1))):
            rows = whole if split == "all" else folds.filter(F.col("fold") == int(split))
            paths[split] = work_path(s.spark, "csv")
            files.write_csv(rows.filter(F.col("domain") == d).select(*columns)
                            .toDF(*schemas.SCAN_HEADER), paths[split])
        out.append(files.read_scans(s.spark, paths).withColumn("domain", F.lit(d)))
    return union_all(out)


# Cohort --------------------------------------------------------------------------------

@query("earliest_event", """
SELECT person_id, observation_date, label_type, visit_occurrence_id FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id
    ORDER BY observation_date, label_type, visit_occurrence_id) AS rn FROM labelled)
WHERE rn = 1""")
def earliest_event(s: Study) -> DataFrame:
    rows = cohort.label_observations(s.cdm.observations, s.cfg.max_date, s.cfg)
    return cohort.earliest_event(rows, ["person_id"], "observation_date",
                                 ["label_type", "visit_occurrence_id"])


@query("base_cohort", f"SELECT {COHORT} FROM base_cohort")
def base_cohort(s: Study) -> DataFrame:
    return s.base_cohort


@query("make_cohort", f"SELECT {COHORT} FROM adjusted")
def make_cohort(s: Study) -> DataFrame:
    return s.adjusted


@query("code_adjust", """
SELECT b.pasc_flag AS was_flag, a.pasc_flag, a.observation_type, count(*) AS persons,
       count(DISTINCT a.index_date) AS index_dates
FROM base_cohort b LEFT JOIN adjusted a ON a.person_id = b.person_id GROUP BY ALL""")
def code_adjust(s: Study) -> DataFrame:
    after = cohort.code_adjust(s.base_cohort, s.cdm.conditions, s.cdm.visits, s.cdm.rules,
                               s.cfg.max_date)
    before = s.base_cohort.select("person_id", F.col("pasc_flag").alias("was_flag"))
    return (before.join(after, "person_id", "left")
            .groupBy("was_flag", "pasc_flag", "observation_type")
            .agg(F.count("*").alias("persons"),
                 F.countDistinct("index_date").alias("index_dates")))


@query("filter_visits", f"SELECT {COHORT} FROM followed")
def filter_visits(s: Study) -> DataFrame:
    return s.followed


@query("impute_dates", f"SELECT {COHORT} FROM imputed")
def impute_dates(s: Study) -> DataFrame:
    return s.imputed


@query("cohort_demo", f"SELECT {DEMO} FROM demo")
def cohort_demo(s: Study) -> DataFrame:
    return s.demo.select(*_columns(DEMO))


@query("filter_dates", f"SELECT {DEMO} FROM dated")
def filter_dates(s: Study) -> DataFrame:
    return s.dated.select(*_columns(DEMO))


@query("entry_period", f"SELECT {STUDY} FROM study")
def entry_period(s: Study) -> DataFrame:
    return s.cohort.select(*_columns(STUDY))


@query("stratified_folds", "SELECT person_id, pasc_flag, fold FROM folded")
def stratified_folds(s: Study) -> DataFrame:
    return s.folded.select("person_id", "pasc_flag", "fold")


@query("fold_restrict", """
SELECT t.n::INT AS fold, CASE WHEN t.n = f.fold THEN 'test' ELSE 'train' END AS part,
       f.pasc_flag, count(*) AS persons, sum(f.entry_age)::BIGINT AS age_sum
FROM folded f JOIN (SELECT unnest(range(1, 6)) AS n) t ON true GROUP BY ALL""")
def fold_restrict(s: Study) -> DataFrame:
    return (cohort.fold_memberships(s.folded, s.cfg.folds).groupBy("fold", "part", "pasc_flag")
            .agg(F.count("*").alias("persons"), F.sum("entry_age").alias("age_sum")))


@query("fold_priors", f"""
SELECT split, sum(pasc_flag)::BIGINT AS cases, count(*) AS persons,
       sum(pasc_flag) / count(*) AS case_probability
FROM (SELECT 'all' AS split, pasc_flag, index_date FROM folded
      UNION ALL SELECT t.n::VARCHAR, pasc_flag, index_date FROM folded
      JOIN (SELECT unnest(range(1, 6)) AS n) t ON t.n <> folded.fold)
WHERE index_date < {months(MAX_DATE, -6)} GROUP BY split""")
def fold_priors(s: Study) -> DataFrame:
    return cohort.split_probs(s.folded, s.cfg.max_date, s.cfg.follow_months, s.cfg.folds)


@query("sample_one", """
SELECT person_id, visit_occurrence_id, visit_start_date FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id
    ORDER BY md5(visit_occurrence_id || '|7')) AS rn FROM visits) WHERE rn = 1""")
def sample_one(s: Study) -> DataFrame:
    rows = s.cdm.visits.select("person_id", "visit_occurrence_id", "visit_start_date")
    return cohort.sample_one(rows, ["person_id"], "visit_occurrence_id", 7)


# Events --------------------------------------------------------------------------------

@query("cluster_visits", """
SELECT s.person_id, s.index_date, s.pasc_flag, e.condition_occurrence_id,
       e.condition_concept_id, c.cluster, v.visit_start_date
FROM folded s JOIN conditions e ON e.person_id = s.person_id
JOIN clusters c ON c.concept_id = e.condition_source_concept_id
JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
WHERE c.cluster NOT IN ('Brand#1', 'Brand#2') AND v.visit_start_date >= s.index_date + 28""")
def cluster_visits(s: Study) -> DataFrame:
    return events.get_cluster_visits(
        s.folded, s.cdm.clusters, s.cdm.conditions, s.cdm.visits, 28,
        s.cfg.excluded_clusters).select(
        "person_id", "index_date", "pasc_flag", "condition_occurrence_id",
        "condition_concept_id", "cluster", "visit_start_date")


@query("cluster_visits_alt", """
SELECT s.person_id, e.condition_occurrence_id, c.cluster, v.visit_start_date,
       CASE WHEN visit_concept_id = 9201 AND i.visit_occurrence_id IS NOT NULL
              THEN 'Inpatient_ICU'
            WHEN visit_concept_id = 9201 THEN 'Inpatient_non_ICU'
            WHEN visit_concept_id = 9203 AND i.visit_occurrence_id IS NOT NULL THEN 'ED_ICU'
            WHEN visit_concept_id = 9203 THEN 'ED_non_ICU'
            WHEN visit_concept_id = 9202 THEN 'Outpatient Office'
            WHEN visit_concept_id = 44814711 THEN 'Outpatient: Test Only'
            WHEN i.visit_occurrence_id IS NOT NULL THEN 'ICU Unknown'
            ELSE 'Other/Unknown' END AS visit_loc
FROM folded s JOIN conditions e ON e.person_id = s.person_id
JOIN clusters c ON c.concept_id = e.condition_source_concept_id
JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
LEFT JOIN icu i ON i.visit_occurrence_id = v.visit_occurrence_id
WHERE v.visit_start_date >= CAST(s.index_date + INTERVAL 1 MONTH AS DATE)""")
def cluster_visits_alt(s: Study) -> DataFrame:
    return events.get_cluster_visits_alt(
        s.folded, s.cdm.clusters, s.cdm.conditions, s.cdm.visits, s.cdm.adt, 1, s.cfg).select(
        "person_id", "condition_occurrence_id", "cluster", "visit_start_date", "visit_loc")


@query("ingredient_drugs", """
SELECT s.person_id, s.index_date, e.concept_id AS drug_concept_id,
       e.event_date AS drug_visit_start_date, i.concept_name
FROM folded s JOIN ev_drug e ON e.person_id = s.person_id
JOIN (SELECT DISTINCT c.concept_name, k.descendant_concept_id FROM concept c
      JOIN closure k ON k.ancestor_concept_id = c.concept_id
      WHERE c.domain_id = 'Drug' AND c.concept_class_id = 'Ingredient') i
  ON i.descendant_concept_id = e.concept_id
WHERE e.event_date >= s.index_date + 28""")
def ingredient_drugs(s: Study) -> DataFrame:
    return events.get_drugs(s.folded, s.cdm.drugs, s.cdm.concept, s.cdm.concept_ancestor,
                            28).select("person_id", "index_date", "drug_concept_id",
                                       "drug_visit_start_date", "concept_name")


@query("util_visits", f"SELECT {IDS}, util_start_date, util_loc FROM util")
def util_visits(s: Study) -> DataFrame:
    return s.util.select(*_columns(IDS), "util_start_date", "util_loc")


@query("lab_events", f"SELECT {IDS}, measurement_concept_id, lab_start_date FROM lab_cts")
def lab_events(s: Study) -> DataFrame:
    return s.lab_cts.select(*_columns(IDS), "measurement_concept_id", "lab_start_date")


def _register_domain(d: str) -> None:
    feature_columns = ["person_id", "index_date", "pasc_flag", "ancestor_concept_id",
                       "ancestor_concept", "descendant_concept_id", "descendant_concept",
                       "visit_start_date"]

    @query(f"feature_visits_{d}", f"SELECT {', '.join(feature_columns)} FROM events_{d}")
    def feature_visits(s: Study) -> DataFrame:
        return s.feature_events(d).select(*feature_columns)

    @query(f"feature_long_{d}", f"SELECT * FROM long_{d}")
    def feature_long(s: Study) -> DataFrame:
        return s.feature_long(d)

    keys = [f"{w.label}_{group_id_of(d, f't|{t}')}" for w in WINDOWS for t in TYPES]
    wide = ", ".join(f"max(CASE WHEN feature_key = '{k}' THEN value ELSE 0 END)::BIGINT "
                     f"AS \"{k}\"" for k in keys)

    @query(f"feature_wide_{d}", f"""
    SELECT f.person_id, f.index_date, f.pasc_flag, {wide}
    FROM folded f LEFT JOIN type_long_{d} t ON t.person_id = f.person_id GROUP BY ALL""")
    def feature_wide(s: Study) -> DataFrame:
        return windows.make_feature_tbl(
            s.folded, d, s.type_features(d), s.cdm.events(d), s.cdm.visits, s.cdm.observations,
            keys, s.cfg.days_delta, cfg=s.cfg)

    @query(f"node_counts_{d}", f"""
    SELECT concept_id AS node, concept_id AS node_concept_id,
           count(DISTINCT person_id) AS pop_count,
           count(DISTINCT CASE WHEN pasc_flag = 1 THEN person_id END) AS case_count,
           count(DISTINCT CASE WHEN pasc_flag = 0 THEN person_id END) AS control_count
    FROM (SELECT s.person_id, s.pasc_flag, e.concept_id FROM study s
          JOIN ev_{d} e ON e.person_id = s.person_id
          JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
          WHERE s.index_date < {months(MAX_DATE, -6)}
            AND v.visit_start_date >= s.index_date - 28
            AND v.visit_start_date < CAST(s.index_date + INTERVAL 6 MONTH AS DATE)
            AND e.concept_id IN (SELECT node_concept_id FROM nodes_{d}))
    GROUP BY concept_id""")
    def node_counts(s: Study) -> DataFrame:
        return s.counts(d)

    if d == "cond":
        root_sql = f"SELECT * FROM tree_{d}"
    else:
        root_sql = f"SELECT * FROM tree_full_{d}"

    @query(f"make_tree_{d}" if d != "cond" else "make_tree",
           root_sql.replace("tree_cond", "tree_full_cond"))
    def make_tree(s: Study) -> DataFrame:
        return s.full_tree(d)

    @query(f"select_cuts_{d}" if d != "cond" else "select_cuts", f"""
    SELECT c.*, n.node_concept, row_number() OVER (
      ORDER BY log_likelihood_ratio DESC, node_identifier) AS cut_rank
    FROM cuts_{d} c LEFT JOIN nodes_{d} n ON n.node_concept_id = c.node_identifier""")
    def select_cuts(s: Study) -> DataFrame:
        return hierarchy.select_cuts(s.scan(d), s.nodes(d), s.cfg.cut_thresholds[d])

    @query(f"make_features_{d}" if d != "cond" else "make_features",
           f"SELECT * FROM features_{d}")
    def make_features(s: Study) -> DataFrame:
        return s.features(d)


for _d in DOMAINS:
    _register_domain(_d)


@query("leak_guard", f"""
SELECT e.event_id AS condition_occurrence_id, s.person_id, k.ancestor_concept_id,
       k.descendant_concept_id, v.visit_start_date
FROM folded s JOIN ev_cond e ON e.person_id = s.person_id
JOIN closure k ON k.descendant_concept_id = e.concept_id
JOIN type_cuts_cond c ON c.node_identifier = k.ancestor_concept_id
JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
WHERE v.visit_start_date >= s.index_date - 28 AND k.ancestor_concept_id <> {PROMO_NODE}
  AND e.event_id NOT IN (SELECT source FROM diagnosis_sources)""")
def leak_guard(s: Study) -> DataFrame:
    tagged = s.feature_events("cond", s.unpruned_type_features("cond"))
    return events.remove_label_events(tagged, s.cdm.observations, DOMAINS["cond"],
                                      s.cfg).select(
        "condition_occurrence_id", "person_id", "ancestor_concept_id", "descendant_concept_id",
        "visit_start_date")


@query("leak_guard_rules", """
SELECT e.condition_occurrence_id, s.person_id, c.cluster, v.visit_start_date
FROM folded s JOIN conditions e ON e.person_id = s.person_id
JOIN clusters c ON c.concept_id = e.condition_source_concept_id
JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
WHERE c.cluster NOT IN ('Brand#1', 'Brand#2') AND v.visit_start_date >= s.index_date - 28
  AND e.condition_occurrence_id NOT IN (SELECT source FROM diagnosis_sources)
  AND NOT regexp_matches(e.condition_source_value, 'ring$')
  AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.action <> 'ignore'
    AND r.condition_concept_id = e.condition_concept_id
    AND r.condition_source_concept_id = e.condition_source_concept_id
    AND r.condition_source_value = e.condition_source_value)""")
def leak_guard_rules(s: Study) -> DataFrame:
    hits = events.get_cluster_visits(s.folded, s.cdm.clusters, s.cdm.conditions, s.cdm.visits,
                                     s.cfg.days_delta, s.cfg.excluded_clusters)
    return events.remove_label_cluster_events(
        hits, s.cdm.observations, s.cdm.rules, s.cfg).select(
        "condition_occurrence_id", "person_id", "cluster", "visit_start_date")


@query("lookback_facts", """
SELECT v.* FROM visits v JOIN folded s ON s.person_id = v.person_id
WHERE s.index_date - v.visit_start_date BETWEEN 0 AND 365""")
def lookback_facts(s: Study) -> DataFrame:
    index = s.folded.select("person_id", F.col("index_date").alias("cohort_start_date"))
    return events.lookback_facts(s.cdm.visits, index, table_name="visit_occurrence")


# Windows -------------------------------------------------------------------------------

@query("window_label", f"""
SELECT w AS "window", util_loc, count(*) AS visits FROM (
  SELECT util_loc, {window_case('util_start_date')} AS w FROM util) WHERE w IS NOT NULL
GROUP BY ALL""")
def window_label(s: Study) -> DataFrame:
    return (windows.assign_window(s.util, "util_start_date").groupBy("window", "util_loc")
            .agg(F.count("*").alias("visits")))


def _wide_sql(source: str, keys: list[str], fill_from: str = "folded f",
              ids: str = "f.person_id, f.index_date, f.pasc_flag") -> str:
    columns = ", ".join(f"coalesce(max(CASE WHEN feature_key = '{k}' THEN value END), 0)"
                        f"::BIGINT AS \"{k}\"" for k in keys)
    join = f"{fill_from} LEFT JOIN ({source}) l ON l.person_id = f.person_id"
    return f"SELECT {ids}, {columns} FROM {join} GROUP BY ALL"


@query("util_window_wide", _wide_sql("SELECT * FROM long_util", windows.util_keys()))
def util_window_wide(s: Study) -> DataFrame:
    return windows.make_util_tbl(s.folded, s.util)


@query("util_window_sparse", """
SELECT person_id, index_date, observation_type, pasc_flag, """ + ", ".join(
    f"max(CASE WHEN feature_key = '{k}' THEN value ELSE 0 END)::BIGINT AS \"{k}\""
    for k in windows.util_keys()) + " FROM long_util GROUP BY ALL")
def util_window_sparse(s: Study) -> DataFrame:
    return windows.partition_dates_and_pivot_wide_util(s.util)


@query("util_unsplit", _wide_sql("""
SELECT person_id, util_loc AS feature_key, count(DISTINCT util_start_date) AS value FROM util
WHERE util_start_date > index_date + 27 AND util_start_date < index_date + 180
GROUP BY ALL""", list(UTIL_LOCATIONS)))
def util_unsplit(s: Study) -> DataFrame:
    return windows.make_util_tbl(s.folded, s.util, False, s.cfg.days_min, s.cfg.days_max)


@query("util_by_fold", """
SELECT t.n::INT AS fold, CASE WHEN t.n = f.fold THEN 'test' ELSE 'train' END AS part,
       l.feature_key, sum(l.value)::BIGINT AS days, count(*) AS persons
FROM folded f JOIN long_util l ON l.person_id = f.person_id
JOIN (SELECT unnest(range(1, 6)) AS n) t ON true GROUP BY ALL""")
def util_by_fold(s: Study) -> DataFrame:
    # The fold travels with the rows, so no fold table is joined back.
    rows = windows.util_long(s.util, ids=("person_id", "fold"))
    per_fold = rows.groupBy("fold", "feature_key").agg(F.sum("value").alias("days"),
                                                       F.count("*").alias("persons"))
    return (cohort.fold_memberships(per_fold, s.cfg.folds)
            .groupBy("fold", "part", "feature_key")
            .agg(F.sum("days").alias("days"), F.sum("persons").alias("persons")))


_CLUSTER_KEYS = [f"{w.label}_{b}" for w in WINDOWS for b in BRANDS]


@query("cluster_window_wide", _wide_sql(f"""
SELECT person_id, w || '_' || cluster AS feature_key, 1 AS value FROM (
  SELECT s.person_id, c.cluster, {window_case('v.visit_start_date', 's.index_date')} AS w
  FROM folded s JOIN conditions e ON e.person_id = s.person_id
  JOIN clusters c ON c.concept_id = e.condition_source_concept_id
  JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
  WHERE v.visit_start_date >= s.index_date - 28) WHERE w IS NOT NULL
GROUP BY ALL""", _CLUSTER_KEYS))
def cluster_window_wide(s: Study) -> DataFrame:
    hits = events.get_cluster_visits(s.folded, s.cdm.clusters, s.cdm.conditions, s.cdm.visits,
                                     s.cfg.days_delta, ())
    long = windows.presence_flags(hits, "visit_start_date", "cluster", ids=windows.COHORT_IDS)
    return windows.to_wide(long, windows.COHORT_IDS, _CLUSTER_KEYS, s.folded)


@query("cluster_unsplit", f"""
SELECT {IDS}, """ + ", ".join(
    f"max((cluster = '{b}')::INT)::BIGINT AS \"{b}\"" for b in BRANDS) + f"""
FROM (SELECT s.*, c.cluster FROM folded s JOIN conditions e ON e.person_id = s.person_id
  JOIN clusters c ON c.concept_id = e.condition_source_concept_id
  JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
  WHERE v.visit_start_date > s.index_date + 27 AND v.visit_start_date < s.index_date + 180)
GROUP BY {IDS}""")
def cluster_unsplit(s: Study) -> DataFrame:
    hits = events.get_cluster_visits(s.folded, s.cdm.clusters, s.cdm.conditions, s.cdm.visits,
                                     s.cfg.days_delta, ())
    return windows.partition_dates_and_pivot_wide_features(
        hits, list(BRANDS), "cluster", split_dates=False, days_min=s.cfg.days_min,
        days_max=s.cfg.days_max)


@query("feature_unsplit_cond", f"""
SELECT DISTINCT {IDS}, ancestor_concept_id::VARCHAR AS feature_key, 1::BIGINT AS value
FROM type_safe_cond
WHERE visit_start_date > index_date + 27 AND visit_start_date < index_date + 180""")
def feature_unsplit_cond(s: Study) -> DataFrame:
    return windows.feature_long(
        s.folded, "cond", s.type_features("cond"), s.cdm.conditions, s.cdm.visits,
        s.cdm.observations, s.cfg.days_delta, False, s.cfg.days_min, s.cfg.days_max, s.cfg,
        windows.IDS)


@query("lab_counts_wide", _wide_sql("SELECT * FROM long_lab_cts", windows.lab_count_keys()))
def lab_counts_wide(s: Study) -> DataFrame:
    return windows.make_lab_count_tbl(s.folded, s.lab_cts)


@query("lab_counts_unsplit", """
SELECT person_id, index_date, observation_type, pasc_flag, sum(days)::BIGINT AS n_labs FROM (
  SELECT person_id, index_date, observation_type, pasc_flag, measurement_concept_id,
         count(DISTINCT lab_start_date) AS days FROM lab_cts
  WHERE lab_start_date > index_date + 27 AND lab_start_date < index_date + 180
  GROUP BY ALL) GROUP BY ALL""")
def lab_counts_unsplit(s: Study) -> DataFrame:
    return windows.partition_dates_and_pivot_wide_lab_cts(
        s.lab_cts, False, s.cfg.days_min, s.cfg.days_max)


# Hierarchy -----------------------------------------------------------------------------

@query("tree_prune", "SELECT * FROM tree_cond")
def tree_prune(s: Study) -> DataFrame:
    return s.tree("cond")


@query("tree_nodes", "SELECT * FROM nodes_cond")
def tree_nodes(s: Study) -> DataFrame:
    return s.nodes("cond")


@query("tree_roots", """
SELECT DISTINCT '' AS ancestor_concept_name, NULL::BIGINT AS ancestor_concept_id,
       '' AS descendant_concept_name, ancestor_concept_id AS descendant_concept_id
FROM tree_lab WHERE ancestor_concept_id NOT IN (SELECT descendant_concept_id FROM tree_lab)""")
def tree_roots(s: Study) -> DataFrame:
    return hierarchy.tree_roots(s.tree("lab"))


@query("tree_export", """
SELECT DISTINCT ancestor_concept_name, ancestor_concept_id, descendant_concept_name,
       descendant_concept_id FROM tree_cond
UNION SELECT '', NULL, 'Clinical finding', 441840
UNION SELECT '', NULL, 'Disorder confirmed', 4194404""")
def tree_export(s: Study) -> DataFrame:
    return hierarchy.tree_export(s.tree("cond"), s.cfg.condition_roots)


@query("tree_export_roots", """
SELECT DISTINCT ancestor_concept_name, ancestor_concept_id, descendant_concept_name,
       descendant_concept_id FROM tree_drug
UNION SELECT '', NULL, '', ancestor_concept_id FROM tree_drug
WHERE ancestor_concept_id NOT IN (SELECT descendant_concept_id FROM tree_drug)""")
def tree_export_roots(s: Study) -> DataFrame:
    return hierarchy.tree_export(s.tree("drug"))


def _fold_counts_sql(d: str) -> str:
    return f"""
SELECT '{d}' AS domain, split, concept_id AS node, concept_id AS node_concept_id,
       count(DISTINCT person_id) AS pop_count,
       count(DISTINCT CASE WHEN pasc_flag = 1 THEN person_id END) AS case_count,
       count(DISTINCT CASE WHEN pasc_flag = 0 THEN person_id END) AS control_count
FROM (SELECT m.split, m.person_id, m.pasc_flag, e.concept_id
      FROM (SELECT 'all' AS split, person_id, pasc_flag, index_date FROM folded
            UNION ALL SELECT t.n::VARCHAR, person_id, pasc_flag, index_date FROM folded
            JOIN (SELECT unnest(range(1, 6)) AS n) t ON t.n <> folded.fold) m
      JOIN ev_{d} e ON e.person_id = m.person_id
      JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
      WHERE m.index_date < {months(MAX_DATE, -6)} AND v.visit_start_date >= m.index_date - 28
        AND v.visit_start_date < CAST(m.index_date + INTERVAL 6 MONTH AS DATE)
        AND e.concept_id IN (SELECT node_concept_id FROM nodes_{d}))
GROUP BY split, concept_id"""


@query("node_counts_by_fold", "\nUNION ALL\n".join(_fold_counts_sql(d) for d in DOMAINS))
def node_counts_by_fold(s: Study) -> DataFrame:
    return s.counts_by_fold("stacked")


@query("expand_cuts", """
SELECT DISTINCT k.ancestor_concept_id, k.descendant_concept_id FROM cuts_proc c
JOIN closure k ON k.ancestor_concept_id = c.node_identifier""")
def expand_cuts(s: Study) -> DataFrame:
    return hierarchy.expand_cuts(s.cuts("proc"), s.cdm.concept, s.cdm.concept_ancestor,
                                 DOMAINS["proc"])


@query("expand_cuts_dedup", """
SELECT ancestor_concept_id, descendant_concept_id FROM (
  SELECT k.ancestor_concept_id, k.descendant_concept_id, row_number() OVER (
    PARTITION BY k.descendant_concept_id
    ORDER BY c.log_likelihood_ratio DESC, c.node_identifier) AS rn
  FROM scan_drug c JOIN closure k ON k.ancestor_concept_id = c.node_identifier
  WHERE c.p_value IS NOT NULL) WHERE rn = 1""")
def expand_cuts_dedup(s: Study) -> DataFrame:
    every_level = replace(s.cfg.cut_thresholds["drug"], level=1, level_op=">=", observations=1,
                          p_value=1.0)
    cuts = hierarchy.significant(s.scan("drug"), every_level)
    return hierarchy.expand_cuts(cuts, s.cdm.concept, s.cdm.concept_ancestor, DOMAINS["drug"],
                                 deduplicate=True)


def _each_domain(sql: str) -> str:
    return " UNION ALL ".join(sql.replace("{d}", d) for d in DOMAINS)


@query("fold_cuts", _each_domain("""
SELECT '{d}' AS domain, fold::INT AS fold, node_identifier, log_likelihood_ratio,
  row_number() OVER (
    PARTITION BY fold ORDER BY log_likelihood_ratio DESC, node_identifier) AS cut_rank
FROM cuts_fold_{d}"""))
def fold_cuts(s: Study) -> DataFrame:
    ranked = hierarchy.select_cuts(
        s.fold_scan(STACKED.name), s.nodes(STACKED.name).drop("domain").distinct(),
        s.cfg.cut_thresholds[STACKED.name], by=("domain", "fold"))
    return ranked.select("domain", "fold", "node_identifier", "log_likelihood_ratio", "cut_rank")


_TOP = 3


@query("top_cuts", f"""
SELECT * FROM ({_each_domain("""
  SELECT '{d}' AS domain, fold::INT AS fold, node_identifier, log_likelihood_ratio,
    row_number() OVER (
      PARTITION BY fold ORDER BY log_likelihood_ratio DESC, node_identifier) AS cut_rank
  FROM cuts_fold_{d}""")}) WHERE cut_rank <= {_TOP}""")
def top_cuts(s: Study) -> DataFrame:
    """The best few cuts of each domain and training set."""
    best = hierarchy.select_cuts(
        s.fold_scan(STACKED.name), s.nodes(STACKED.name).drop("domain").distinct(),
        s.cfg.cut_thresholds[STACKED.name], by=("domain", "fold"), k=_TOP)
    return best.select("domain", "fold", "node_identifier", "log_likelihood_ratio", "cut_rank")


@query("fold_features", _each_domain("""
SELECT '{d}' AS domain, fold::INT AS fold, ancestor_concept_id, descendant_concept_id
FROM features_fold_{d}"""))
def fold_features(s: Study) -> DataFrame:
    return s.fold_features(STACKED.name).select(
        "domain", "fold", "ancestor_concept_id", "descendant_concept_id")


@query("cut_overlap", """
SELECT folds, count(*) AS nodes FROM (
  SELECT node_identifier, string_agg(fold::VARCHAR, ',' ORDER BY fold) AS folds
  FROM (""" + _each_domain("SELECT node_identifier, fold FROM cuts_fold_{d}") + """)
  GROUP BY node_identifier) GROUP BY folds""")
def cut_overlap(s: Study) -> DataFrame:
    return hierarchy.cut_overlap(s.fold_cuts(STACKED.name))


# Codesets ------------------------------------------------------------------------------

@query("get_descendants", """
SELECT DISTINCT c.concept_id, c.concept_name, c.concept_code, c.vocabulary_id
FROM codeset s JOIN closure k ON k.ancestor_concept_id = s.concept_id
JOIN concept c ON c.concept_id = k.descendant_concept_id""")
def get_descendants(s: Study) -> DataFrame:
    return codesets.get_descendants(s.cdm.codeset(), s.cdm.concept, s.cdm.concept_ancestor)


_FOUND = """
SELECT r.code AS concept_code, r.description, c.concept_id, c.concept_name, c.vocabulary_id
FROM raw_codes r JOIN concept c ON c.concept_code = r.code
WHERE c.invalid_reason IS NULL AND c.vocabulary_id IN ('ICD10CM', 'ICD10')"""
_MAPPED = f"""
SELECT DISTINCT f.concept_id AS source_concept_id, c.concept_id AS std_concept_id,
       c.concept_name AS std_concept_name, c.concept_code AS std_concept_code,
       c.vocabulary_id AS std_vocabulary_id, f.concept_code AS orig_code,
       f.vocabulary_id AS source_vocabulary_id, f.description AS orig_description
FROM ({_FOUND}) f JOIN relationship r ON r.concept_id_1 = f.concept_id
JOIN concept c ON c.concept_id = r.concept_id_2
WHERE r.relationship_id = 'Maps to' AND r.invalid_reason IS NULL"""


def _found(s: Study) -> DataFrame:
    return codesets.find_concepts_from_codes(s.cdm.raw_codes, s.cdm.concept,
                                             ["ICD10CM", "ICD10"])


def _mapped(s: Study) -> DataFrame:
    return codesets.standardize_concepts(_found(s), s.cdm.concept, s.cdm.concept_relationship)


@query("find_concepts_codes", _FOUND)
def find_concepts_codes(s: Study) -> DataFrame:
    return _found(s)


@query("find_concepts_ids", f"""
SELECT concept_id, concept_name, concept_code, vocabulary_id, concept_name AS description
FROM concept WHERE invalid_reason IS NULL
  AND concept_id IN (SELECT concept_id_1 FROM relationship)""")
def find_concepts_ids(s: Study) -> DataFrame:
    ids = s.cdm.concept_relationship.select(F.col("concept_id_1").alias("concept_id")).distinct()
    return codesets.find_concepts_from_cids(ids, s.cdm.concept, valid_only=True)


@query("standardize_concepts", _MAPPED)
def standardize_concepts(s: Study) -> DataFrame:
    return _mapped(s)


_EXPANDED = f"""
SELECT DISTINCT d.concept_id AS std_concept_id, d.concept_name AS std_concept_name,
       d.concept_code AS std_concept_code, d.vocabulary_id AS std_vocabulary_id,
       m.std_concept_id AS ancestor_concept_id, m.std_concept_name AS ancestor_concept_name
FROM (SELECT DISTINCT std_concept_id, std_concept_name FROM ({_MAPPED})) m
JOIN closure k ON k.ancestor_concept_id = m.std_concept_id
JOIN concept d ON d.concept_id = k.descendant_concept_id"""


@query("expand_codeset", _EXPANDED)
def expand_codeset(s: Study) -> DataFrame:
    std = _mapped(s).select("std_concept_id", "std_concept_name").distinct()
    return codesets.expand_codeset(std, s.cdm.concept, s.cdm.concept_ancestor)


@query("infer_vocabularies", r"""
SELECT DISTINCT v AS vocabulary_id FROM (
  SELECT regexp_extract(description, '\((\w+)\)\s*$', 1) AS v FROM raw_codes
  UNION ALL SELECT 'ICD10' FROM raw_codes WHERE description LIKE '%(ICD10CM)')
WHERE v <> ''""")
def infer_vocabularies(s: Study) -> DataFrame:
    return codesets.infer_vocabularies(s.cdm.raw_codes)


@query("process_codes", f"""
SELECT 'Source codes' AS metric, count(*) AS n FROM (SELECT DISTINCT * FROM raw_codes)
UNION ALL SELECT 'Source concepts', count(*) FROM (SELECT DISTINCT * FROM ({_FOUND}))
UNION ALL SELECT 'Mapped concepts', count(DISTINCT source_concept_id) FROM ({_MAPPED})
UNION ALL SELECT 'Standard concepts', count(DISTINCT std_concept_id) FROM ({_MAPPED})""")
def process_codes(s: Study) -> DataFrame:
    vocabularies = codesets.infer_vocabularies(s.cdm.raw_codes)
    return codesets.process_codes(s.cdm.raw_codes, s.cdm.concept, s.cdm.concept_relationship,
                                  vocabularies)[2]


def _merged(s: Study) -> tuple[DataFrame, DataFrame]:
    mapped = _mapped(s)
    parts = [mapped.filter(F.col("source_vocabulary_id") == v) for v in ("ICD10CM", "ICD10")]
    return codesets.merge_sets(parts, s.cdm.concept, s.cdm.concept_ancestor)


@query("merge_sets", f"""
SELECT DISTINCT std_concept_id AS concept_id, std_concept_name AS concept_name,
       std_concept_code AS concept_code, std_vocabulary_id AS vocabulary_id
FROM ({_EXPANDED})""")
def merge_sets(s: Study) -> DataFrame:
    return _merged(s)[1]


@query("process_code_files", _MAPPED)
def process_code_files(s: Study) -> DataFrame:
    """Codes read from a file; what is returned comes from the file of mapped concepts."""
    def read(path: str) -> DataFrame:
        codesets.process_codes_from_file(s.spark, path, s.cdm.concept, s.cdm.concept_relationship)
        return files.read_csv(s.spark, f"{path}_mapped.csv", _mapped(s).schema)

    return _csv_round_trip(s, s.cdm.raw_codes, read)


@query("merge_set_files", f"""
SELECT DISTINCT std_concept_id AS concept_id, std_concept_name AS concept_name,
       std_concept_code AS concept_code, std_vocabulary_id AS vocabulary_id
FROM ({_EXPANDED})""")
def merge_set_files(s: Study) -> DataFrame:
    mapped, paths = _mapped(s), []
    for vocabulary in ("ICD10CM", "ICD10"):
        paths.append(work_path(s.spark, "csv"))
        files.write_csv(mapped.filter(F.col("source_vocabulary_id") == vocabulary).select(
            *[f.name for f in schemas.STD_CONCEPTS.fields]), paths[-1])
    return codesets.merge_sets_from_files(s.spark, paths, s.cdm.concept, s.cdm.concept_ancestor)[1]


@query("descendant_summary", f"""
SELECT ancestor_concept_name, count(*) AS desc_ct FROM ({_EXPANDED}) GROUP BY 1""")
def descendant_summary(s: Study) -> DataFrame:
    return codesets.descendant_summary(_merged(s)[0])


# De-identification and audit --------------------------------------------------------------

@query("gen_xwalk", """
SELECT person_id, row_number() OVER (ORDER BY person_id) AS seq_id
FROM (SELECT DISTINCT person_id FROM visits)""")
def gen_xwalk(s: Study) -> DataFrame:
    return deid.gen_xwalk(s.cdm.visits, "person_id")


_XWALK = """(SELECT person_id, row_number() OVER (ORDER BY person_id) AS seq_id
  FROM (SELECT DISTINCT person_id FROM folded))"""


@query("new_id", f"""
SELECT v.visit_occurrence_id, v.visit_start_date, x.seq_id AS person_id
FROM visits v LEFT JOIN {_XWALK} x ON x.person_id = v.person_id""")
def new_id(s: Study) -> DataFrame:
    xwalk = deid.gen_xwalk(s.folded, "person_id")
    return deid.new_id(s.cdm.visits.drop("visit_concept_id"), "person_id", xwalk, replace=True)


@query("dates_to_ages", """
SELECT v.visit_occurrence_id, v.person_id, v.visit_concept_id,
       (v.visit_start_date - p.birth_date)::INT AS visit_start_age
FROM visits v JOIN person p ON p.person_id = v.person_id""")
def dates_to_ages(s: Study) -> DataFrame:
    return deid.dates_to_ages(s.cdm.visits, s.cdm.person)


@query("scrub_person_info", f"""
SELECT x.seq_id AS person_id, f.pasc_flag, f.fold, f.site,
       (f.index_date - f.birth_date)::INT AS index_age
FROM folded f JOIN {_XWALK} x ON x.person_id = f.person_id""")
def scrub_person_info(s: Study) -> DataFrame:
    rows = s.folded.select("person_id", "pasc_flag", "fold", "site", "index_date", "birth_date")
    return deid.scrub_person_info(rows, s.cdm.person)


@query("add_site", """
SELECT p.site, count(*) AS visits, count(DISTINCT v.person_id) AS persons
FROM visits v LEFT JOIN person p ON p.person_id = v.person_id GROUP BY p.site""")
def add_site(s: Study) -> DataFrame:
    return deid.add_site(s.cdm.visits, s.cdm.person).groupBy("site").agg(
        F.count("*").alias("visits"), F.countDistinct("person_id").alias("persons"))


@query("attrition", """
SELECT 1 AS step_number, 'cohort' AS step, count(DISTINCT person_id) AS persons,
       count(*) AS "rows" FROM adjusted
UNION ALL SELECT 2, 'follow-up visits', count(DISTINCT person_id), count(*) FROM followed
UNION ALL SELECT 3, 'age', count(DISTINCT person_id), count(*) FROM demo
UNION ALL SELECT 4, 'study period', count(DISTINCT person_id), count(*) FROM dated
UNION ALL SELECT 5, 'entry period', count(DISTINCT person_id), count(*) FROM study""")
def attrition(s: Study) -> DataFrame:
    """The passes that write the tables count them."""
    log = audit.StepLog(s.spark, "star")
    s.adjusted = stored(log.observed(s.adjusted, step="cohort"))
    s.followed = stored(log.observed(s.followed, step="follow-up visits"))
    s.demo = log.observed(s.demo, step="age")
    s.dated = log.observed(s.dated, step="study period")
    s.cohort_table = stored(log.observed(s.cohort, step="entry period"))
    return log.frame().select("step_number", "step", "persons", "rows")


@query("step_log", """
SELECT 1 AS step_number, 'star' AS site, 'Start' AS cohort, 0::BIGINT AS persons,
       NULL::BIGINT AS "rows", true AS timed
UNION ALL SELECT 2, 'star', 'All labelled', count(DISTINCT person_id), count(*), true
FROM base_cohort
UNION ALL SELECT 3, 'star', 'Corrected', count(DISTINCT person_id), count(*), true
FROM adjusted""")
def step_log(s: Study) -> DataFrame:
    """The log as its sink returns it; one step is counted on its own, one while written."""
    log = audit.StepLog(s.spark, "star").init_sum(cohort="Start", persons=0)
    log.append_sum(cohort="All labelled", persons=s.base_cohort)
    stored(log.observed(s.adjusted, cohort="Corrected"))
    catalog = TableCatalog(s.spark, "", "", work_path(s.spark, "results"))
    timed = F.col("used").rlike(r"^[0-9.]+;[0-9.]+;[0-9.]+$") & F.col("logged_at").isNotNull()
    log.output_sum(catalog)
    return catalog.results_tbl("star_steps").withColumn("timed", timed).drop("logged_at", "used")


@query("distinct_ct", "SELECT count(DISTINCT person_id) AS dist_ct FROM visits")
def distinct_ct(s: Study) -> DataFrame:
    return deid.distinct_ct(s.cdm.visits)


# Labels --------------------------------------------------------------------------------

_SITES = {"AFRICA": "Site A", "AMERICA": "Site B", "ASIA": "Site C", "EUROPE": "Site D"}
_TITLES = "CASE w " + " ".join(f"WHEN '{w.label}' THEN '{w.title}'" for w in WINDOWS) + " END"


def _demo_label_sql() -> str:
    table = {**{f"site_{k}": v for k, v in _SITES.items()}, **labels.DEMO_LABELS}
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return (f"CASE feature_key {arms} ELSE CASE WHEN feature_key LIKE 'cohort_entry_%' "
            f"THEN 'Cohort entry: ' || substr(feature_key, 14) ELSE feature_key END END")


_LOCATIONS = "CASE util_loc " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in labels.LOCATION_LABELS.items()) + " ELSE util_loc END"


@query("label_demo", f"""
SELECT DISTINCT feature_key, {_demo_label_sql()} AS label FROM long_demo""")
def label_demo(s: Study) -> DataFrame:
    keys = assemble.one_hot_demo(s.folded).select("feature_key").distinct()
    return keys.withColumn("label", labels.label_demo(F.col("feature_key"), _SITES))


def _named_keys(s: Study, domain: str) -> DataFrame:
    rows = windows.assign_window(s.feature_events(domain), "visit_start_date")
    return rows.select(F.concat_ws("_", "window", "ancestor_concept").alias("feature_key")
                       ).distinct()


@query("label_cond", f"""
SELECT DISTINCT w || '_' || ancestor_concept AS feature_key,
       split_part(ancestor_concept, ',', 1) || ' ' || {_TITLES} AS label
FROM (SELECT ancestor_concept, {window_case('visit_start_date')} AS w FROM events_cond)
WHERE w IS NOT NULL""")
def label_cond(s: Study) -> DataFrame:
    return _named_keys(s, "cond").withColumn("label", labels.label_cond(F.col("feature_key")))


@query("label_drug", f"""
SELECT feature_key, upper(substr(t, 1, 1)) || lower(substr(t, 2)) || ' ' || {_TITLES} AS label
FROM (SELECT DISTINCT w || '_' || ancestor_concept AS feature_key, w,
             split_part(split_part(ancestor_concept, ',', 1), '_', 2) AS t
      FROM (SELECT ancestor_concept, {window_case('visit_start_date')} AS w FROM events_drug)
      WHERE w IS NOT NULL)""")
def label_drug(s: Study) -> DataFrame:
    return _named_keys(s, "drug").withColumn("label", labels.label_drug(F.col("feature_key")))


@query("label_util", f"""
SELECT DISTINCT util_loc || '_' || w AS feature_key,
       {_LOCATIONS} || ' visits ' || {_TITLES} AS label
FROM (SELECT util_loc, {window_case('util_start_date')} AS w FROM util) WHERE w IS NOT NULL""")
def label_util(s: Study) -> DataFrame:
    keys = windows.util_long(s.util).select("feature_key").distinct()
    return keys.withColumn("label", labels.label_util(F.col("feature_key")))


@query("label_labcts", f"""
SELECT DISTINCT w AS feature_key, 'Lab count ' || {_TITLES} AS label
FROM (SELECT feature_key AS w FROM long_lab_cts)""")
def label_labcts(s: Study) -> DataFrame:
    keys = windows.lab_count_long(s.lab_cts).select("feature_key").distinct()
    return keys.withColumn("label", labels.label_lab_cts(F.col("feature_key")))


@query("feature_dictionary", f"""
SELECT 'demo' AS domain, feature_key, NULL AS "window", {_demo_label_sql()} AS label
FROM (SELECT DISTINCT feature_key FROM long_demo)
UNION ALL
SELECT 'util', util_loc || '_' || w, w, {_LOCATIONS} || ' visits ' || {_TITLES}
FROM (SELECT DISTINCT util_loc, {window_case('util_start_date')} AS w FROM util)
WHERE w IS NOT NULL
UNION ALL
SELECT 'lab_cts', w, w, 'Lab count ' || {_TITLES}
FROM (SELECT DISTINCT feature_key AS w FROM long_lab_cts)
UNION ALL
""" + " UNION ALL ".join(f"""
SELECT '{d}', w || '_' || id, w, split_part(node_concept, ',', 1) || ' ' || {_TITLES}
FROM (SELECT DISTINCT ancestor_concept_id AS id, {window_case('visit_start_date')} AS w
      FROM safe_{d}) k JOIN nodes_{d} n ON n.node_concept_id = k.id WHERE w IS NOT NULL"""
    for d in DOMAINS))
def feature_dictionary(s: Study) -> DataFrame:
    nodes = s.nodes(STACKED.name).drop("domain").distinct()
    return labels.feature_dictionary(s.long, nodes, _SITES)


# Model assembly ------------------------------------------------------------------------

@query("one_hot_demo", "SELECT * FROM long_demo")
def one_hot_demo(s: Study) -> DataFrame:
    return assemble.one_hot_demo(s.folded)


@query("assemble_long", "SELECT * FROM long_all")
def assemble_long(s: Study) -> DataFrame:
    return s.long


_FOLD_ROWS = """
SELECT l.feature_key, f.fold FROM long_all l JOIN folded f ON f.person_id = l.person_id
WHERE l.domain IN ('demo', 'util', 'lab_cts')
UNION ALL """ + _each_domain(f"""
SELECT {window_case('v.visit_start_date')} || '_' || c.ancestor_concept_id, s.fold
FROM folded s JOIN ev_{{d}} e ON e.person_id = s.person_id
JOIN features_fold_{{d}} c ON c.descendant_concept_id = e.concept_id AND c.fold = 1
JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
WHERE v.visit_start_date >= s.index_date - 28 AND {window_case('v.visit_start_date')} IS NOT NULL
  AND c.ancestor_concept_id <> {PROMO_NODE}
  AND ('{{d}}' <> 'cond' OR e.event_id NOT IN (SELECT source FROM diagnosis_sources))""")


@query("common_features", f"""
SELECT DISTINCT feature_key FROM ({_FOLD_ROWS}) WHERE fold <> 1
INTERSECT
SELECT DISTINCT feature_key FROM ({_FOLD_ROWS}) WHERE fold = 1""")
def common_features(s: Study) -> DataFrame:
    return assemble.common_features(*s.split(1))


@query("label3", """
SELECT person_id, (pasc_flag + pasc_not_misc_flag)::INT AS label FROM folded""")
def label3(s: Study) -> DataFrame:
    return s.labelled.select("person_id", "label")


@query("zscore", """
SELECT person_id, domain, feature_key, round((value - mean) / sd, 6) AS value,
       round(-mean / sd, 6) AS zero_value
FROM (SELECT *, CASE WHEN var > 1e-24 THEN sqrt(var) ELSE 1 END AS sd FROM (
  SELECT *, s / n AS mean, greatest(q / n - (s / n) ** 2, 0) AS var FROM (
    SELECT person_id, domain, feature_key, value, sum(value) OVER f AS s,
           sum(value * value) OVER f AS q, (SELECT count(*) FROM folded) AS n
    FROM long_all WINDOW f AS (PARTITION BY feature_key))))""")
def zscore(s: Study) -> DataFrame:
    """Scaled stored entries, with the value that an absent one has."""
    stats = stored(assemble.feature_stats(s.long_table, s.folded))
    scaled = assemble.scale(s.long_table, stats).join(
        stats.select("feature_key", "zero_value"), "feature_key")
    return scaled.withColumns({c: F.round(c, 6) for c in ("value", "zero_value")})


# Metrics -------------------------------------------------------------------------------

def _confusion_sql(source: str, thresholds: list[float], op: str, by: str) -> str:
    values = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    return f"""
SELECT {by}, threshold, sum((y = 1 AND p {op} threshold)::INT) AS tp,
       sum((y = 0 AND p {op} threshold)::INT) AS fp,
       sum((y = 1 AND NOT p {op} threshold)::INT) AS fn,
       sum((y = 0 AND NOT p {op} threshold)::INT) AS tn
FROM {source} JOIN (VALUES {values}) t(threshold) ON true GROUP BY ALL"""


def _threshold_sql(source: str, thresholds: list[float], op: str, by: str) -> str:
    return f"""
SELECT {by}, threshold, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS "precision",
       round(coalesce(tn / nullif(tn + fp, 0), 0), 9) AS specificity,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
       round(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0) - 1, 9)
         AS youden_j
FROM ({_confusion_sql(source, thresholds, op, by)})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c, t in df.dtypes
                           if t == "double" and c != "threshold"})


_AUROC = """
SELECT fold, task, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auroc
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold, task ORDER BY p
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT fold, task, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg
            FROM ovr GROUP BY ALL)) GROUP BY fold, task"""
_AP = """
SELECT fold, task, round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS average_precision
FROM (SELECT fold, task, p, pos,
             sum(pos) OVER (PARTITION BY fold, task ORDER BY p DESC) AS tp,
             sum(neg) OVER (PARTITION BY fold, task ORDER BY p DESC) AS fp
      FROM (SELECT fold, task, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg
            FROM ovr GROUP BY ALL)) GROUP BY fold, task"""


def _ovr(s: Study) -> DataFrame:
    return metrics.one_vs_rest(s.cdm.predictions, ("fold",))


@query("metrics_threshold", _threshold_sql("ovr", [0.2, 0.5], ">", "fold, task"))
def metrics_threshold(s: Study) -> DataFrame:
    return _rounded(metrics.threshold_metrics(_ovr(s), [0.5, 0.2], ">", ("fold", "task")))


@query("metrics_threshold_at_least", _threshold_sql("ovr", [0.2, 0.49], ">=", "task"))
def metrics_threshold_at_least(s: Study) -> DataFrame:
    return _rounded(metrics.threshold_metrics(_ovr(s), [0.49, 0.2], ">=", ("task",)))


@query("metrics_auroc", _AUROC)
def metrics_auroc(s: Study) -> DataFrame:
    return _rounded(metrics.rank_metrics(_ovr(s), ("fold", "task"))).drop("average_precision")


@query("metrics_avg_precision", _AP)
def metrics_avg_precision(s: Study) -> DataFrame:
    return _rounded(metrics.rank_metrics(_ovr(s), ("fold", "task"))).drop("auroc")


_ALL_METRICS = f"""
SELECT t.*, a.auroc, p.average_precision
FROM ({_threshold_sql('ovr', [0.2, 0.5], '>', 'fold, task')}) t
JOIN ({_AUROC}) a ON a.fold = t.fold AND a.task = t.task
JOIN ({_AP}) p ON p.fold = t.fold AND p.task = t.task"""


@query("metrics_one_vs_rest", _ALL_METRICS)
def metrics_one_vs_rest(s: Study) -> DataFrame:
    return _rounded(metrics.score_multiclass(s.cdm.predictions, s.cfg.thresholds))


@query("score_row", "SELECT fold, threshold, " + ", ".join(
    f"max(CASE WHEN task = '{t}' THEN \"{m}\" END) AS {m}_{t}"
    for t in metrics.TASKS for m in metrics.METRICS)
    + f" FROM ({_ALL_METRICS}) WHERE threshold = 0.2 GROUP BY fold, threshold")
def score_row(s: Study) -> DataFrame:
    return _rounded(metrics.get_scores(s.cdm.predictions, 0.2))


@query("score_multioutput", _threshold_sql(
    "(SELECT 'any' AS task, (y3 > 0)::INT AS y, 1 - p0 AS p FROM predictions "
    "UNION ALL SELECT 'a_only', (y3 = 2)::INT, p2 FROM predictions)", [0.3], ">=", "task"))
def score_multioutput(s: Study) -> DataFrame:
    rows = s.cdm.predictions.select(
        (F.col("y3") > 0).cast("int").alias("y_any"), (F.col("y3") == 2).cast("int")
        .alias("y_a"), (1 - F.col("p0")).alias("p_any"), F.col("p2").alias("p_a"))
    return _rounded(metrics.score_multioutput(
        rows, {"any": ("y_any", "p_any"), "a_only": ("y_a", "p_a")}, 0.3)
        .drop("auroc", "average_precision"))


_SWEEP = [round(0.05 * i, 2) for i in range(1, 20)]


@query("youden_sweep", f"""
SELECT fold, threshold, youden_j FROM (
  {_threshold_sql("ovr", _SWEEP, ">", "fold, task")}) WHERE fold = 1 AND task = 'pasc_any'""")
def youden_sweep(s: Study) -> DataFrame:
    return _rounded(metrics.youden_sweep(s.cdm.predictions, _SWEEP))


# Training ----------------------------------------------------------------------------------

def _prepared(s: Study) -> Study:
    """The folds written once before the iterative part."""
    s.folded = stored(s.folded)
    return s


def _boosted(s: Study) -> boosting.Ensemble:
    """Models of all five folds, each on the features of its own cuts."""
    s = _prepared(s)
    defined = plans.defined_keys(s.fold_long_table, s.fold_feature_table, s.cfg.folds)
    return boosting.cross_validate(s.folded, s.fold_long_table, defined, s.cfg.folds,
                                   boosting.Boost.of(s.cfg))


@query("train_cv")
def train_cv(s: Study) -> DataFrame:
    return train.cv_metrics(_boosted(s).predictions(), s.cfg.thresholds)


@query("train_cv_facts", f"""
SELECT fold, count(*) AS persons, count(*) AS predicted_once,
       sum((pasc_flag + pasc_not_misc_flag = 0)::INT)::BIGINT AS n0,
       sum((pasc_flag + pasc_not_misc_flag = 1)::INT)::BIGINT AS n1,
       sum((pasc_flag + pasc_not_misc_flag = 2)::INT)::BIGINT AS n2, count(*) AS sums_to_one,
       count(*) AS repeated, {3 * STAR_CONFIG.trees}::BIGINT AS trees,
       {STAR_CONFIG.trees - 1}::BIGINT AS rounds_that_fell
FROM folded GROUP BY fold""")
def train_cv_facts(s: Study) -> DataFrame:
    """What holds for the boosted ensemble of every fold.

    ``repeated`` counts persons whose scores from the stored nodes equal the trainer's.
    """
    fitted = _boosted(s)
    predictions, nodes = fitted.predictions(), stored(fitted.nodes)
    whole = F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) < 1e-9
    again = boosting.score(nodes, s.folded, s.fold_long_table).select(
        F.col("model").alias("fold"), "person_id", *[F.col(f"p{k}").alias(f"q{k}") for k in range(3)])
    same = F.greatest(*[F.abs(F.col(f"p{k}") - F.col(f"q{k}")) for k in range(3)]) < 1e-9
    people = predictions.join(again, ["person_id", "fold"]).groupBy("fold").agg(
        F.count("*").alias("persons"), F.count_distinct("person_id").alias("predicted_once"),
        *[F.sum((F.col("y3") == k).cast("long")).alias(f"n{k}") for k in range(3)],
        F.sum(whole.cast("long")).alias("sums_to_one"), F.sum(same.cast("long")).alias("repeated"))
    grown = nodes.groupBy(F.col("model").alias("fold")).agg(
        F.count_distinct("tree", "klass").alias("trees"))
    loss = fitted.loss_table(s.spark)
    later = loss.select("model", (F.col("round") + 1).alias("round"), F.col("loss").alias("before"))
    fell = loss.join(later, ["model", "round"]).groupBy(F.col("model").alias("fold")).agg(
        F.sum((F.col("loss") < F.col("before")).cast("long")).alias("rounds_that_fell"))
    return people.join(grown, "fold").join(fell, "fold")


def _full_scores(s: Study) -> tuple[DataFrame, DataFrame]:
    """(trainer's probabilities, those of the saved and reloaded nodes) of a fit on everybody."""
    s = _prepared(s)
    long = stored(s.defined(0).drop("fold"))
    fitted = boosting.train_full(s.folded, long, boosting.Boost.of(s.cfg))
    path = work_path(s.spark, "model")
    boosting.save(fitted, path)
    return fitted.predictions(), boosting.score(boosting.load(s.spark, path), s.folded, long)


@query("train_full")
def train_full(s: Study) -> DataFrame:
    return _full_scores(s)[1].drop("model")


@query("train_full_facts", """
SELECT pasc_flag + pasc_not_misc_flag AS y3, count(*) AS persons, count(*) AS repeated
FROM folded GROUP BY 1""")
def train_full_facts(s: Study) -> DataFrame:
    """Persons whose scores from the reloaded nodes equal the trainer's."""
    first, again = _full_scores(s)
    again = again.select("person_id", *[F.col(f"p{k}").alias(f"q{k}") for k in range(3)])
    same = F.greatest(*[F.abs(F.col(f"p{k}") - F.col(f"q{k}")) for k in range(3)]) < 1e-9
    return first.join(again, "person_id").groupBy("y3").agg(
        F.count("*").alias("persons"), F.sum(same.cast("long")).alias("repeated"))


@query("grid_search")
def grid_search(s: Study) -> DataFrame:
    s = _prepared(s)
    parts = {k: train.fold_vectors(s.folded, *s.split(k), k, F.col("pasc_flag"))
             for k in range(1, s.cfg.folds + 1)}
    return train.model_eval(LogisticRegression(), parts, {"regParam": [0.01, 0.1]})


@query("wide_slots", """
SELECT person_id, slot, feature_key, max(value) AS value
FROM long_all JOIN (
  SELECT feature_key, row_number() OVER (ORDER BY feature_key)::INT - 1 AS slot
  FROM (SELECT DISTINCT feature_key FROM long_all)) USING (feature_key)
GROUP BY ALL HAVING max(value) <> 0""")
def wide_slots(s: Study) -> DataFrame:
    """The wide table of all features, saved by group of columns and read back cell by cell."""
    s = _prepared(s)
    slots, path = wide.slot_table(s.long_table), work_path(s.spark, "wide")
    wide.save_wide(wide.slot_arrays(s.folded.select("person_id"), s.long_table, slots), path)
    cells = s.spark.read.parquet(path).select(
        "person_id", "slot_group", F.posexplode("cells").alias("at", "value")).filter("value <> 0")
    slot = (F.col("slot_group") * wide.WIDTH + F.col("at")).cast("int")
    return (cells.withColumn("slot", slot).join(slots, "slot")
            .select("person_id", "slot", "feature_key", "value"))


@query("model_slots", "SELECT DISTINCT feature_key, domain IN ('util', 'lab_cts') "
       "OR feature_key = 'entry_age' AS counted FROM long_all")
def model_slots(s: Study) -> DataFrame:
    """The slots of the feature vectors, flags and counts."""
    counted = F.col("domain").isin(*assemble.COUNT_DOMAINS) | (F.col("feature_key") == assemble.AGE_KEY)
    return s.long.select("feature_key", counted.alias("counted")).distinct()
