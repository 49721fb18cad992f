"""Case/control cohort construction, correction, restriction and folds."""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.config import PhenotypeConfig
from cohortloom.functions.dates import age_in_years, follow_up_possible, month_period
from cohortloom.functions.hashing import seeded_digest, uniform_int

# Label texts of the cohort table and actions of the rule table.
TYPE_A, TYPE_B = "pasc", "misc"
TYPE_PCR, TYPE_ANTIGEN, TYPE_SEROLOGY = "pcr", "antigen", "serology"
FINAL_A, FINAL_B = "non_misc_pasc", "misc"
ACTION_SWITCH, ACTION_DROP, ACTION_IGNORE = "pasc", "drop", "ignore"

COHORT_COLUMNS = ("person_id", "pasc_flag", "pasc_not_misc_flag", "index_date",
                  "observation_type", "index_visit_occurrence_id")


def observation_class(cfg: PhenotypeConfig) -> Column:
    """Label type of an observation, null when it is neither a diagnosis nor a positive test."""
    concept, value = F.col("observation_concept_id"), F.col("value_as_concept_id")
    diagnosis = concept == cfg.diagnosis_concept
    positive = value.isin(*cfg.positive_values)
    return (F.when(diagnosis & (value == cfg.diagnosis_a_value), TYPE_A)
            .when(diagnosis & (value == cfg.diagnosis_b_value), TYPE_B)
            .when((concept == cfg.pcr_concept) & positive, TYPE_PCR)
            .when((concept == cfg.antigen_concept) & positive, TYPE_ANTIGEN)
            .when((concept == cfg.serology_concept) & positive, TYPE_SEROLOGY))


def label_observations(observations: DataFrame, max_date: date,
                       cfg: PhenotypeConfig) -> DataFrame:
    """Observations up to max_date (inclusive) that matter, with their label type.

    The concept test repeats what the label needs so that it reaches the scan.
    """
    return (observations
            .filter((F.col("observation_date") <= F.lit(max_date))
                    & F.col("observation_concept_id").isin(
                        *cfg.test_concepts, cfg.diagnosis_concept))
            .select("person_id", "observation_date", "visit_occurrence_id",
                    observation_class(cfg).alias("label_type"))
            .filter(F.col("label_type").isNotNull()))


def earliest_event(events: DataFrame, keys: Sequence[str], date_col: str,
                   tiebreak: Sequence[str]) -> DataFrame:
    """The earliest row of each key, ties settled by the tiebreak columns.

    A minimum over a struct combines on the map side, so a key with very many
    rows is reduced before the shuffle and never sorted in one task.
    """
    picked = [date_col, *tiebreak]
    return (events.groupBy(*keys)
            .agg(F.min(F.struct(*picked)).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in picked]))


def base_cohort(observations: DataFrame, max_date: date,
                cfg: PhenotypeConfig = PhenotypeConfig()) -> DataFrame:
    """One row per person before rule correction.

    Persons with a diagnosis are cases from their earliest diagnosis; all other
    persons with a positive test are controls from their earliest test.  One
    scan and one shuffle decide both.
    """
    case = F.col("label_type").isin(TYPE_A, TYPE_B)
    row = F.struct("observation_date", "label_type", "visit_occurrence_id")
    persons = (label_observations(observations, max_date, cfg)
               .groupBy("person_id")
               .agg(F.min(F.when(case, row)).alias("case_row"),
                    F.min(F.when(~case, row)).alias("test_row"),
                    F.max((F.col("label_type") == TYPE_B).cast("int")).alias("has_b")))
    first = F.coalesce("case_row", "test_row")
    is_case = F.col("case_row").isNotNull()
    return persons.select(
        "person_id",
        is_case.cast("int").alias("pasc_flag"),
        (is_case & (F.col("has_b") == 0)).cast("int").alias("pasc_not_misc_flag"),
        first["observation_date"].alias("index_date"),
        first["label_type"].alias("observation_type"),
        first["visit_occurrence_id"].alias("index_visit_occurrence_id"))


def rule_events(conditions: DataFrame, rules: DataFrame) -> DataFrame:
    """Conditions that match a rule on all three key columns, with the action."""
    keys = ["condition_concept_id", "condition_source_concept_id", "condition_source_value"]
    return conditions.join(rules.select(*keys, "action"), keys)


def code_adjust(cohort: DataFrame, conditions: DataFrame, visits: DataFrame,
                rules: DataFrame, max_date: date) -> DataFrame:
    """Correct controls by later rule conditions.

    ``drop`` removes the person, whatever else is found; the switching action
    makes the person a case from the earliest such visit; ``ignore`` does
    nothing.  Visits count strictly after the index date and before max_date.

    Rules are joined first: they are few and cut the fact table down before it
    meets visits and persons.
    """
    acting = rules.filter(F.col("action").isin(ACTION_SWITCH, ACTION_DROP))
    dated = (rule_events(conditions, acting)
             .select("person_id", "visit_occurrence_id", "action")
             .join(visits.filter(F.col("visit_start_date") < F.lit(max_date))
                   .select("visit_occurrence_id", "visit_start_date"),
                   "visit_occurrence_id"))
    controls = cohort.filter("pasc_flag = 0").select("person_id", "index_date")
    verdict = (dated.join(controls, "person_id")
               .filter(F.col("visit_start_date") > F.col("index_date"))
               .groupBy("person_id")
               .agg(F.max((F.col("action") == ACTION_DROP).cast("int")).alias("dropped"),
                    F.min(F.when(F.col("action") == ACTION_SWITCH,
                                 F.col("visit_start_date"))).alias("switch_date")))
    switched = F.col("switch_date").isNotNull()
    flag = F.when(switched, 1).otherwise(F.col("pasc_flag"))
    not_b = F.when(switched, 1).otherwise(F.col("pasc_not_misc_flag"))
    return (cohort.join(verdict, "person_id", "left")
            .filter(F.coalesce("dropped", F.lit(0)) == 0)
            .select("person_id",
                    flag.alias("pasc_flag"),
                    not_b.alias("pasc_not_misc_flag"),
                    F.coalesce("switch_date", "index_date").alias("index_date"),
                    F.when((flag == 1) & (not_b == 1), FINAL_A)
                    .when(flag == 1, FINAL_B)
                    .when(flag == 0, F.col("observation_type")).alias("observation_type"),
                    "index_visit_occurrence_id"))


def make_cohort(observations: DataFrame, conditions: DataFrame, visits: DataFrame,
                rules: DataFrame, max_date: date,
                cfg: PhenotypeConfig = PhenotypeConfig()) -> DataFrame:
    """Base cohort corrected by the rule table."""
    return code_adjust(base_cohort(observations, max_date, cfg),
                       conditions, visits, rules, max_date)


def filter_visits(cohort: DataFrame, visits: DataFrame, n_visits: int) -> DataFrame:
    """Keep persons with at least n distinct visit dates strictly after the index date."""
    enough = (cohort.select("person_id", "index_date")
              .join(visits.select("person_id", "visit_start_date"), "person_id")
              .filter(F.col("visit_start_date") > F.col("index_date"))
              .groupBy("person_id")
              .agg(F.countDistinct("visit_start_date").alias("visit_days"))
              .filter(F.col("visit_days") >= n_visits))
    return cohort.join(enough, "person_id", "left_semi")


def filter_dates(cohort: DataFrame, min_date: date, max_date: date) -> DataFrame:
    """min_date <= index date < max_date - 1 month."""
    return cohort.filter((F.col("index_date") >= F.lit(min_date))
                         & follow_up_possible("index_date", max_date, 1))


def impute_dates(cohort: DataFrame, min_window: int = -90, max_window: int = -28,
                 seed: int = 1234) -> DataFrame:
    """Shift the index date of cases by one seeded uniform draw of days per person."""
    shift = uniform_int(F.col("person_id"), seed, min_window, max_window)
    moved = F.when(F.col("pasc_flag") == 1, F.date_add("index_date", shift)
                   ).otherwise(F.col("index_date"))
    return cohort.withColumn("index_date", moved)


def sample_one(df: DataFrame, keys: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """One seeded random row per key, chosen by the smallest digest of id and seed."""
    return (df.withColumn("_digest", seeded_digest(F.col(id_col), seed))
            .groupBy(*keys)
            .agg(F.min(F.struct("_digest", *df.columns)).alias("_row"))
            .select(*[F.col(f"_row.{c}").alias(c) for c in df.columns]))


def join_cohort_demo(cohort: DataFrame, person: DataFrame,
                     cfg: PhenotypeConfig = PhenotypeConfig()) -> DataFrame:
    """Attach birth date, site, entry age, sex and ethnicity; keep ages under the cap."""
    gender, race = F.col("gender_concept_id"), F.col("race_concept_id")
    sex = (F.when(gender == cfg.male, "Male").when(gender == cfg.female, "Female")
           .otherwise("Other/unknown"))
    ethnicity = (F.when(F.col("ethnicity_concept_id") == cfg.hispanic, "Hispanic")
                 .when(race == cfg.black, "Black/AA")
                 .when(race.isin(*cfg.asian), "Asian/PI")
                 .when(race == cfg.white, "White")
                 .when(race == cfg.multiple_race, "Multiple")
                 .otherwise("Other/Unknown"))
    demo = person.select("person_id", F.to_date("birth_date").alias("birth_date"), "site",
                         sex.alias("sex_cat"), ethnicity.alias("eth_cat"))
    return (cohort.withColumn("index_date", F.to_date("index_date"))
            .join(demo, "person_id")
            .withColumn("entry_age", age_in_years("birth_date", "index_date"))
            .filter(F.col("entry_age") < cfg.max_age))


def get_cohort_entry_period(cohort: DataFrame,
                            cfg: PhenotypeConfig = PhenotypeConfig()) -> DataFrame:
    """Month, year and period label of the index date; dates outside all periods are dropped."""
    return (cohort.withColumns({
        "index_month": F.month("index_date"),
        "index_year": F.year("index_date"),
        "cohort_entry_period": month_period("index_date", cfg.entry_periods)})
        .filter(F.col("cohort_entry_period").isNotNull()))


def split_cohort(cohort: DataFrame, folds: int = 5, seed: int = 11015,
                 flag: str = "pasc_flag", prefix_digits: int = 3) -> DataFrame:
    """Add ``fold`` 1..k, balanced to within one person for each flag value.

    Persons are dealt out in the order of a seeded digest.  The order is found
    per digest prefix, which spreads evenly over 16**prefix_digits groups per
    flag value, and shifted by the sizes of the earlier prefixes.
    """
    keyed = (cohort.withColumn("_digest", seeded_digest(F.col("person_id"), seed))
             .withColumn("_prefix", F.substring("_digest", 1, prefix_digits)))
    sizes = keyed.groupBy(flag, "_prefix").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(W.partitionBy(flag).orderBy("_prefix")) - F.col("_size")
    # At most 16**prefix_digits rows per flag value, whatever the cohort size.
    offsets = F.broadcast(sizes.select(flag, "_prefix", before.alias("_before")))
    place = F.row_number().over(
        W.partitionBy(flag, "_prefix").orderBy("_digest", "person_id"))
    return (keyed.withColumn("_place", place)
            .join(offsets, [flag, "_prefix"])
            .withColumn("fold", ((F.col("_before") + F.col("_place") - 1) % folds + 1)
                        .cast("int"))
            .select(*cohort.columns, "fold"))


def fold_train(cohort: DataFrame, fold: int) -> DataFrame:
    """Everyone outside the fold."""
    return cohort.filter(F.col("fold") != fold)


def fold_test(cohort: DataFrame, fold: int) -> DataFrame:
    """Everyone in the fold."""
    return cohort.filter(F.col("fold") == fold)


def fold_memberships(cohort: DataFrame, folds: int = 5) -> DataFrame:
    """Train and test rows of all folds: k rows per person with ``part``."""
    number = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    return (cohort.withColumnRenamed("fold", "_own")
            .withColumn("fold", number)
            .withColumn("part", F.when(F.col("fold") == F.col("_own"), "test")
                        .otherwise("train"))
            .drop("_own"))


def split_probs(cohort: DataFrame, max_date: date, follow_months: int,
                folds: int = 5) -> DataFrame:
    """Case share of each train set and of the whole cohort (``all``)."""
    per_fold = (cohort.filter(follow_up_possible("index_date", max_date, follow_months))
                .groupBy("fold")
                .agg(F.sum("pasc_flag").cast("long").alias("cases"),
                     F.count("*").alias("persons")))
    sets = F.explode(F.concat(
        F.array(F.lit("all")),
        F.transform(F.filter(F.sequence(F.lit(1), F.lit(folds)),
                             lambda i: i != F.col("fold")), lambda i: i.cast("string"))))
    return (per_fold.withColumn("split", sets)
            .groupBy("split")
            .agg(F.sum("cases").alias("cases"), F.sum("persons").alias("persons"))
            .withColumn("case_probability", F.col("cases") / F.col("persons")))
