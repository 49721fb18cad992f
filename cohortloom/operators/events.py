"""Event retrieval relative to the index date, and label-leak guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import DOMAINS, STACKED, Domain, PhenotypeConfig
from cohortloom.functions.dates import since_index, since_index_months
from cohortloom.functions.distributed import union_all
from cohortloom.operators.cohort import ACTION_IGNORE

RULE_KEYS = ["condition_concept_id", "condition_source_concept_id", "condition_source_value"]


def with_visit(events: DataFrame, visits: DataFrame, *columns: str) -> DataFrame:
    """Give events the attributes of their visit, by default its start date."""
    wanted = columns or ("visit_start_date",)
    return events.join(visits.select("visit_occurrence_id", *wanted), "visit_occurrence_id")


def cohort_events(cohort: DataFrame, events: DataFrame, visits: DataFrame,
                  *columns: str) -> DataFrame:
    """Events of cohort members with visit attributes.

    Persons come first: they reduce the fact table before it is shuffled by visit.
    """
    return with_visit(events.join(cohort, "person_id"), visits, *columns)


def icu_visits(adt: DataFrame, cfg: PhenotypeConfig) -> DataFrame:
    """Distinct visits with an intensive-care service."""
    return (adt.filter(F.col("service_concept_id").isin(*cfg.icu_services))
            .select("visit_occurrence_id").distinct().withColumn("icu", F.lit(1)))


def visit_location(cfg: PhenotypeConfig, icu_unknown: bool = False) -> Column:
    """Location class from the visit concept and a nullable 0/1 ``icu`` column."""
    visit, icu = F.col("visit_concept_id"), F.coalesce("icu", F.lit(0)) == 1
    inpatient = visit.isin(*cfg.inpatient_visits)
    emergency = visit.isin(*cfg.ed_visits)
    place = (F.when(inpatient & icu, "Inpatient_ICU")
             .when(inpatient, "Inpatient_non_ICU")
             .when(emergency & icu, "ED_ICU")
             .when(emergency, "ED_non_ICU")
             .when(visit.isin(*cfg.office_visits), "Outpatient Office")
             .when(visit.isin(*cfg.test_only_visits), "Outpatient: Test Only"))
    if icu_unknown:
        place = place.when(icu, "ICU Unknown")
    return place.otherwise("Other/Unknown")


def get_cluster_visits(cohort: DataFrame, clusters: DataFrame, conditions: DataFrame,
                       visits: DataFrame, days_delta: int = 28,
                       excluded: tuple[str, ...] = PhenotypeConfig.excluded_clusters
                       ) -> DataFrame:
    """Conditions whose source concept is in a cluster, from index + delta days on."""
    kept = clusters.filter(~F.col("cluster").isin(*excluded)) if excluded else clusters
    return _clustered(cohort, kept, conditions, visits, "visit_start_date").filter(
        since_index("visit_start_date", "index_date", days_delta))


def get_cluster_visits_alt(cohort: DataFrame, clusters: DataFrame, conditions: DataFrame,
                           visits: DataFrame, adt: DataFrame, months_delta: int = 0,
                           cfg: PhenotypeConfig = PhenotypeConfig()) -> DataFrame:
    """Cluster conditions from index + delta months on, with the visit location."""
    dated = _clustered(cohort, clusters, conditions, visits,
                       "visit_start_date", "visit_concept_id").filter(
        since_index_months("visit_start_date", "index_date", months_delta))
    return (dated.join(icu_visits(adt, cfg), "visit_occurrence_id", "left")
            .withColumn("visit_loc", visit_location(cfg, icu_unknown=True))
            .drop("visit_concept_id", "icu"))


def _clustered(cohort: DataFrame, clusters: DataFrame, conditions: DataFrame,
               visits: DataFrame, *columns: str) -> DataFrame:
    member = clusters.withColumnRenamed("concept_id", "condition_source_concept_id")
    return cohort_events(cohort, conditions.join(member, "condition_source_concept_id"),
                         visits, *columns)


def ingredient_descendants(concept: DataFrame, closure: DataFrame) -> DataFrame:
    """(ingredient name, concept at or below it) pairs."""
    ingredients = concept.filter((F.col("domain_id") == "Drug")
                                 & (F.col("concept_class_id") == "Ingredient"))
    return (ingredients.select(F.col("concept_id").alias("ancestor_concept_id"), "concept_name")
            .join(closure.select("ancestor_concept_id", "descendant_concept_id"),
                  "ancestor_concept_id")
            .select("concept_name", "descendant_concept_id").distinct())


def get_drugs(cohort: DataFrame, drugs: DataFrame, concept: DataFrame, closure: DataFrame,
              days_delta: int = 28) -> DataFrame:
    """Exposures at or below an ingredient from index + delta on, dated by exposure start.

    An exposure that several ingredients cover gives one row for each.
    """
    exposures = drugs.select(
        "person_id", F.col("drug_concept_id"),
        F.col("drug_exposure_start_date").alias("drug_visit_start_date"))
    named = ingredient_descendants(concept, closure).withColumnRenamed(
        "descendant_concept_id", "drug_concept_id")
    return (exposures.join(cohort, "person_id")
            .filter(since_index("drug_visit_start_date", "index_date", days_delta))
            .join(named, "drug_concept_id"))


def get_util(cohort: DataFrame, visits: DataFrame, adt: DataFrame, days_delta: int = 28,
             cfg: PhenotypeConfig = PhenotypeConfig()) -> DataFrame:
    """Visits from index + delta on, by location class."""
    dated = visits.select("person_id", "visit_occurrence_id", "visit_concept_id",
                          F.col("visit_start_date").alias("util_start_date"))
    return (dated.join(cohort, "person_id")
            .filter(since_index("util_start_date", "index_date", days_delta))
            .join(icu_visits(adt, cfg), "visit_occurrence_id", "left")
            .withColumn("util_loc", visit_location(cfg))
            .drop("visit_occurrence_id", "visit_concept_id", "icu"))


def get_lab_cts(cohort: DataFrame, labs: DataFrame, visits: DataFrame,
                days_delta: int = 28) -> DataFrame:
    """Lab rows whose visit starts on or after index + delta."""
    return (cohort_events(cohort, labs, visits)
            .withColumnRenamed("visit_start_date", "lab_start_date")
            .filter(since_index("lab_start_date", "index_date", days_delta))
            .drop("visit_occurrence_id"))


def stack_events(tables: dict[str, DataFrame]) -> DataFrame:
    """Event tables of several domains as (domain, person, visit, concept, event id) rows.

    The visit and person joins then run once instead of once per domain.
    """
    return union_all([
        df.select(F.lit(name).alias("domain"), "person_id", "visit_occurrence_id",
                  F.col(DOMAINS[name].concept_col).alias(STACKED.concept_col),
                  (F.col(DOMAINS[name].event_id_col) if DOMAINS[name].event_id_col
                   else F.lit(None)).alias(STACKED.event_id_col))
        for name, df in tables.items()])


def feature_events(cohort: DataFrame, features: DataFrame, events: DataFrame,
                   visits: DataFrame, domain: Domain, days_delta: int = 28) -> DataFrame:
    """Events whose concept is a feature descendant, from index + delta on.

    One row for every feature that covers the concept.
    """
    by = ["domain"] if domain.members else []
    return (cohort_events(cohort, events, visits)
            .filter(since_index("visit_start_date", "index_date", days_delta))
            .withColumnRenamed(domain.concept_col, "descendant_concept_id")
            .join(features, [*by, "descendant_concept_id"]))


def guarded_feature_days(cohort: DataFrame, features: DataFrame, events: DataFrame,
                         visits: DataFrame, observations: DataFrame, domain: Domain,
                         days_delta: int = 28,
                         cfg: PhenotypeConfig = PhenotypeConfig()) -> DataFrame:
    """Distinct (cohort columns, domain, feature, visit date) without label events.

    Persons come first, then the label guard, visits and dates; what is left is made
    distinct by concept and day before a concept meets the features, so that a frequent
    concept fans out over few rows.
    """
    by = ["domain"] if domain.members else []
    own = events.join(cohort, "person_id")
    if domain.event_id_col is not None:
        own = _drop_label_sources(own, observations, domain.event_id_col, cfg)
    days = (with_visit(own, visits)
            .filter(since_index("visit_start_date", "index_date", days_delta))
            .select(*cohort.columns, *by, F.col(domain.concept_col).alias("descendant_concept_id"),
                    "visit_start_date").distinct())
    pairs = (features.filter(F.col("ancestor_concept_id") != cfg.leak_root)
             .select(*by, "descendant_concept_id", "ancestor_concept_id").distinct())
    return days.join(pairs, [*by, "descendant_concept_id"])


def diagnosis_sources(observations: DataFrame, cfg: PhenotypeConfig) -> DataFrame:
    """Ids of the events behind the label diagnoses."""
    return (observations
            .filter((F.col("observation_concept_id") == cfg.diagnosis_concept)
                    & F.col("value_as_concept_id").isin(*cfg.diagnosis_values))
            .select(F.col("observation_source_concept_id").alias("_source")))


def _drop_label_sources(events: DataFrame, observations: DataFrame, event_id_col: str,
                        cfg: PhenotypeConfig) -> DataFrame:
    """Events without an id can't be a source; they stay out of the join, where they would
    all meet at one key."""
    sources = diagnosis_sources(observations, cfg)
    known = events.filter(F.col(event_id_col).isNotNull())
    safe = known.join(sources, known[event_id_col] == sources["_source"], "left_anti")
    return safe.unionByName(events.filter(F.col(event_id_col).isNull()))


def remove_label_events(events: DataFrame, observations: DataFrame, domain: Domain,
                        cfg: PhenotypeConfig = PhenotypeConfig()) -> DataFrame:
    """Drop feature events behind a label diagnosis and features rooted at the leak concept.

    The id anti-join applies only to a domain that carries the event id; rows
    without one never match.
    """
    safe = events.filter(F.col("ancestor_concept_id") != cfg.leak_root)
    if domain.event_id_col is None:
        return safe
    return _drop_label_sources(safe, observations, domain.event_id_col, cfg)


def remove_label_cluster_events(events: DataFrame, observations: DataFrame, rules: DataFrame,
                                cfg: PhenotypeConfig = PhenotypeConfig()) -> DataFrame:
    """Drop cluster events behind a label diagnosis, under an acting rule, or by source text.

    A null source text is dropped too, as NOT (null matches) is not true in SQL.
    """
    acting = rules.filter(F.col("action") != ACTION_IGNORE).select(*RULE_KEYS)
    plain = events.filter(~F.col("condition_source_value").rlike(cfg.leak_text_pattern))
    return (_drop_label_sources(plain, observations, "condition_occurrence_id", cfg)
            .join(acting, RULE_KEYS, "left_anti"))


def lookback_facts(data: DataFrame, index_tbl: DataFrame, event_date_col: str | None = None,
                   table_name: str | None = None,
                   index_date_col: str = "cohort_start_date",
                   link_col: str = "person_id", lookback: int = 365) -> DataFrame:
    """Facts dated 0 to ``lookback`` days before the index date; the index date is not kept.

    Without an event column it is derived from the table name:
    ``visit_occurrence`` -> ``visit_start_date``.
    """
    if event_date_col is None:
        if table_name is None:
            raise ValueError("give event_date_col or table_name")
        event_date_col = table_name.lower().removesuffix("_occurrence") + "_start_date"
    index = index_tbl.select(link_col, F.col(index_date_col).alias("_index"))
    return (data.join(index, link_col)
            .filter(F.datediff(F.col("_index"), F.col(event_date_col)).between(0, lookback))
            .drop("_index"))
