"""The four jobs of a study, reading and writing through one catalog.

Each job writes its results as tables, so the next one starts from stored data
with known sizes, and a lost executor costs tasks, not a whole lineage.  Folds
are a column; no table is written per fold.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.config import DOMAINS, STACKED, CutThreshold, PhenotypeConfig
from cohortloom.functions.distributed import union_all
from cohortloom.functions.labels import feature_dictionary
from cohortloom.operators import assemble, audit, boosting, events, hierarchy, train, wide, windows
from cohortloom.operators import cohort as cohorts
from cohortloom.sources import files
from cohortloom.sources.catalog import TableCatalog


def build_cohort(catalog: TableCatalog, cfg: PhenotypeConfig, rules_path: str,
                 clusters_path: str | None = None) -> DataFrame:
    """Rules and clusters published, cohort built, restricted, dated and dealt into folds."""
    rules = catalog.output_tbl(files.read_rules(catalog.spark, rules_path), "rules")
    if clusters_path is not None:
        catalog.output_tbl(files.read_clusters(catalog.spark, clusters_path), "cluster_master")
    visits = catalog.cdm_tbl("visit_occurrence")
    log = audit.StepLog(catalog.spark, cfg.site)  # counted by the passes that write the tables
    made = catalog.compute_new(log.observed(cohorts.make_cohort(
        catalog.cdm_tbl("observation_derivation"), catalog.cdm_tbl("condition_occurrence"),
        visits, rules, cfg.max_date, cfg), step="labelled"), "cohort_labelled")
    followed = catalog.compute_new(log.observed(cohorts.filter_visits(
        made, visits, cfg.n_visits), step="follow-up visits"), "cohort_followed")
    moved = cohorts.impute_dates(followed, cfg.min_window, cfg.max_window, cfg.impute_seed)
    aged = log.observed(cohorts.join_cohort_demo(moved, catalog.cdm_tbl("person"), cfg), step="age")
    clipped = log.observed(cohorts.filter_dates(aged, cfg.min_date, cfg.max_date),
                           step="study period")
    study = catalog.compute_new(log.observed(cohorts.get_cohort_entry_period(clipped, cfg),
                                             step="entry period"), "cohort_study")
    folded = catalog.output_tbl(cohorts.split_cohort(study, cfg.folds, cfg.seed), "cohort")
    log.output_sum(catalog)
    catalog.output_tbl(log.frame().select("persons", "rows", "step_number", "step"), "attrition")
    return folded


def stacked_events(catalog: TableCatalog) -> DataFrame:
    """Events of all domains as one frame."""
    return events.stack_events({d.name: catalog.cdm_tbl(d.table) for d in DOMAINS.values()})


def build_tree_inputs(catalog: TableCatalog, cfg: PhenotypeConfig) -> dict[str, DataFrame]:
    """Trees, their exports, person counts for all and every training set, case shares."""
    concept = catalog.vocabulary_tbl("concept")
    closure = catalog.vocabulary_tbl("concept_ancestor")
    tree = catalog.output_tbl(hierarchy.make_tree(concept, closure, STACKED, cfg.leak_root),
                              "tree")
    for name in DOMAINS:
        own = tree.filter(F.col("domain") == name).drop("domain")
        roots = cfg.condition_roots if name == "cond" else None
        catalog.output_tbl(hierarchy.tree_export(own, roots), f"tree_{name}")
    cohort = catalog.results_tbl("cohort")
    counts = hierarchy.node_counts_by_fold(
        tree, cohort, stacked_events(catalog), catalog.cdm_tbl("visit_occurrence"), STACKED,
        cfg.days_delta, cfg.follow_months, cfg.max_date, cfg.folds)
    return {
        "tree": tree,
        "counts": catalog.output_tbl(counts, "node_counts", partition_by=["domain", "split"]),
        "priors": catalog.output_tbl(
            cohorts.split_probs(cohort, cfg.max_date, cfg.follow_months, cfg.folds),
            "case_priors")}


def read_cuts(catalog: TableCatalog, cfg: PhenotypeConfig,
              scan_paths: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Significant nodes of (domain -> split -> result file), ranked within each.

    The drug results on the full cohort have thresholds of their own.
    """
    scans = union_all([files.read_scans(catalog.spark, dict(paths))
                       .withColumn("domain", F.lit(domain))
                       for domain, paths in scan_paths.items()])
    parts = []
    for domain in scan_paths:
        own = scans.filter(F.col("domain") == domain)
        whole = cfg.cut_thresholds.get(f"{domain}_all", cfg.cut_thresholds[domain])
        parts += [hierarchy.significant(own.filter("split = 'all'"), whole),
                  hierarchy.significant(own.filter("split <> 'all'"),
                                        cfg.cut_thresholds[domain])]
    # Already filtered: rank with a threshold everything passes.
    passed = CutThreshold(0, 0, p_value=1.0, p_op="<=")
    nodes = hierarchy.tree_nodes(catalog.results_tbl("tree")).drop("domain").distinct()
    return hierarchy.select_cuts(union_all(parts), nodes, passed, by=("domain", "split"))


def build_features(catalog: TableCatalog, cfg: PhenotypeConfig, cuts: DataFrame,
                   site_labels: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Feature definitions per split, long feature rows, and their dictionary.

    Definitions differ by split, but the events of a person do not: features of
    all splits are found in one pass over the events and carry their split.
    """
    cohort = catalog.results_tbl("cohort")
    visits = catalog.cdm_tbl("visit_occurrence")
    nodes = hierarchy.tree_nodes(catalog.results_tbl("tree"))
    cuts = catalog.output_tbl(cuts, "cuts")
    overlap = hierarchy.cut_overlap(cuts.filter("split <> 'all'"), "split")
    features = catalog.output_tbl(hierarchy.make_features(
        cuts, nodes, catalog.vocabulary_tbl("concept"),
        catalog.vocabulary_tbl("concept_ancestor"), STACKED, by=("domain", "split")), "features")
    distinct = features.drop("split").distinct()
    ids = (*windows.COHORT_IDS, "fold")
    coded = windows.feature_long(
        cohort, STACKED, distinct, stacked_events(catalog), visits,
        catalog.cdm_tbl("observation_derivation"), cfg.days_delta, cfg=cfg, ids=ids)
    util = windows.util_long(
        events.get_util(cohort, visits, catalog.cdm_tbl("adt_occurrence"), cfg.days_delta, cfg),
        windows=cfg.windows, ids=ids)
    labs = windows.lab_count_long(
        events.get_lab_cts(cohort, catalog.cdm_tbl("measurement_labs"), visits, cfg.days_delta),
        windows=cfg.windows, ids=ids)
    long = catalog.output_tbl(
        assemble.assemble_long(cohort, {STACKED.name: coded, "util": util, "lab_cts": labs},
                               ("fold",)),
        "features_long", partition_by=["fold", "domain"])
    labels = nodes.drop("domain").distinct()
    return {"cuts": cuts, "overlap": catalog.output_tbl(overlap, "cut_overlap"),
            "features": features, "long": long,
            "dictionary": catalog.output_tbl(
                feature_dictionary(long, labels, site_labels, cfg.windows),
                "feature_dictionary")}


def split_rows(catalog: TableCatalog, split: str) -> DataFrame:
    """Feature rows as a split defines them: its own coded features, all other blocks."""
    return restrict_to(catalog.results_tbl("features_long"),
                       catalog.results_tbl("features").filter(F.col("split") == split))


def build_wide(catalog: TableCatalog, split: str, path: str) -> DataFrame:
    """A split's wide table, written under ``path`` by group of columns; returns its slots.

    :func:`cohortloom.operators.wide.column_group` reads the columns of a group.
    """
    long = split_rows(catalog, split)
    slots = catalog.output_tbl(wide.slot_table(long), f"slots_{split}")
    members = catalog.results_tbl("cohort").select(*windows.COHORT_IDS, "fold")
    wide.save_wide(wide.slot_arrays(members, long, slots), path)
    return slots


def restrict_to(long: DataFrame, features: DataFrame) -> DataFrame:
    """Long rows of the given coded features, and all rows of other blocks."""
    coded = F.col("domain").isin(*DOMAINS)
    chosen = features.select("domain", F.col("ancestor_concept_id").cast("string").alias("_id")
                             ).distinct()
    # A coded key is "{window}_{concept id}".
    own = (long.filter(coded).withColumn("_id", F.substring_index("feature_key", "_", -1))
           .join(chosen, ["domain", "_id"], "left_semi").drop("_id"))
    return union_all([long.filter(~coded), own.select(*long.columns)])


def defined_keys(long: DataFrame, features: DataFrame, folds: int) -> DataFrame:
    """(fold, feature_key): the keys of ``long`` that each fold's own features define.

    Coded features follow the fold's cuts; all other blocks belong to every fold.
    """
    keys = long.select("domain", "feature_key").distinct()
    coded = F.col("domain").isin(*DOMAINS)
    own = features.select("fold", "domain", F.col("ancestor_concept_id").cast("string").alias("_id")
                          ).distinct()
    # A coded key is "{window}_{concept id}".
    chosen = (keys.filter(coded).withColumn("_id", F.substring_index("feature_key", "_", -1))
              .join(own, ["domain", "_id"]).select("fold", "feature_key"))
    every = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    return chosen.unionByName(keys.filter(~coded).select(every, "feature_key"))


def train_model(catalog: TableCatalog, cfg: PhenotypeConfig, model_path: str,
                estimator=None) -> dict[str, DataFrame]:
    """Cross-validated predictions and metrics, then the fit on everybody.

    The model is the boosted ensemble, whose nodes go to ``model_path`` as a table; an MLlib
    estimator takes its place where one is given.
    """
    if estimator is None:
        return _train_boosted(catalog, cfg, model_path)
    cohort = catalog.results_tbl("cohort")
    longs = {}
    for fold in range(1, cfg.folds + 1):
        rows = split_rows(catalog, str(fold))  # stored by fold, so each filter prunes folders
        longs[fold] = (cohorts.fold_train(rows, fold), cohorts.fold_test(rows, fold))
    predictions = catalog.output_tbl(train.train_cv(cohort, longs, estimator, cfg),
                                     "predictions")
    metrics = catalog.output_tbl(train.cv_metrics(predictions, cfg.thresholds), "cv_metrics")
    model, scaled, names = train.train_full(cohort, split_rows(catalog, "all"), estimator)
    train.save_model(model, model_path)
    catalog.output_tbl(scaled.select("person_id", "label", "scaled"), "scaled_all")
    slots = catalog.copy_to_new(list(enumerate(names)), "model_columns",
                                "slot int, feature_key string")
    return {"predictions": predictions, "metrics": metrics, "columns": slots}


def _train_boosted(catalog: TableCatalog, cfg: PhenotypeConfig, model_path: str
                   ) -> dict[str, DataFrame]:
    cohort, boost = catalog.results_tbl("cohort"), boosting.Boost.of(cfg)
    long, features = catalog.results_tbl("features_long"), catalog.results_tbl("features")
    by_fold = features.filter("split <> 'all'").withColumn("fold", F.col("split").cast("int"))
    ensemble = boosting.cross_validate(cohort, long, defined_keys(long, by_fold, cfg.folds),
                                       cfg.folds, boost)
    predictions = catalog.output_tbl(ensemble.predictions(), "predictions")
    metrics = catalog.output_tbl(train.cv_metrics(predictions, cfg.thresholds), "cv_metrics")
    whole = boosting.train_full(cohort, split_rows(catalog, "all"), boost)
    boosting.save(whole, model_path)
    loss = catalog.output_tbl(ensemble.loss_table(catalog.spark), "cv_loss")
    columns = catalog.output_tbl(whole.slots.select("slot", "feature_key"), "model_columns")
    return {"predictions": predictions, "metrics": metrics, "columns": columns, "loss": loss,
            "nodes": boosting.load(catalog.spark, model_path)}
