"""Concept trees, person counts per node, and features from selected nodes."""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.config import CutThreshold, Domain, compare
from cohortloom.functions.dates import follow_up_possible, in_follow_up
from cohortloom.functions.distributed import union_set
from cohortloom.functions.text import paste
from cohortloom.operators.events import cohort_events


def _by_domain(domain: Domain) -> list[str]:
    return ["domain"] if domain.members else []


def domain_concepts(concept: DataFrame, domain: Domain) -> DataFrame:
    """Concepts of the vocabularies and domain of an event type.

    For stacked domains the ``domain`` column says which one.
    """
    if domain.members:
        label = F.coalesce(*[
            F.when(F.col("vocabulary_id").isin(*d.vocabularies)
                   & (F.col("domain_id") == d.domain_id), d.name) for d in domain.members])
        return concept.withColumn("domain", label).filter(F.col("domain").isNotNull())
    return concept.filter(F.col("vocabulary_id").isin(*domain.vocabularies)
                          & (F.col("domain_id") == domain.domain_id))


def make_tree(concept: DataFrame, closure: DataFrame, domain: Domain,
              prune_root: int | None = None) -> DataFrame:
    """Parent-child edges; parents from the domain, children from any vocabulary.

    Of stacked domains only the condition tree is pruned.
    """
    by = _by_domain(domain)
    parents = (domain_concepts(concept, domain)
               .select(*by, F.col("concept_id").alias("ancestor_concept_id"),
                       F.col("concept_name").alias("ancestor_concept_name")).distinct())
    children = concept.select(F.col("concept_id").alias("descendant_concept_id"),
                              F.col("concept_name").alias("descendant_concept_name"))
    edges = (closure.filter("min_levels_of_separation = 1")
             .select("ancestor_concept_id", "descendant_concept_id")
             .join(parents, "ancestor_concept_id")
             .join(children, "descendant_concept_id")
             .select(*by, "ancestor_concept_id", "ancestor_concept_name",
                     "descendant_concept_id", "descendant_concept_name"))
    return edges if prune_root is None else prune_subtree(edges, concept, closure, prune_root)


def prune_subtree(tree: DataFrame, concept: DataFrame, closure: DataFrame,
                  root: int) -> DataFrame:
    """Drop edges with either end at or below the root (the closure's self row included)."""
    below = (closure.filter(F.col("ancestor_concept_id") == root)
             .select(F.col("descendant_concept_id").alias("_gone"))
             .join(concept.select(F.col("concept_id").alias("_gone")), "_gone", "left_semi"))
    pruned = F.col("domain") == "cond" if "domain" in tree.columns else F.lit(True)
    for end in ("descendant_concept_id", "ancestor_concept_id"):
        tree = tree.join(below, (F.col(end) == F.col("_gone")) & pruned, "left_anti")
    return tree


def tree_nodes(tree: DataFrame) -> DataFrame:
    """(``name, id`` label, id) of every edge end."""
    ends = F.array(*[
        F.struct(paste(f"{end}_concept_name", f"{end}_concept_id").alias("node_concept"),
                 F.col(f"{end}_concept_id").alias("node_concept_id"))
        for end in ("ancestor", "descendant")])
    by = [c for c in ("domain",) if c in tree.columns]
    return tree.select(*by, F.explode(ends).alias("end")).select(*by, "end.*").distinct()


def tree_roots(tree: DataFrame) -> DataFrame:
    """Nodes that are a parent and never a child, as edges without a parent."""
    parents = tree.select(F.col("ancestor_concept_id").alias("_parent")).distinct()
    children = tree.select(F.col("descendant_concept_id").alias("_child"))
    return (parents.join(children, parents["_parent"] == children["_child"], "left_anti")
            .select(F.lit("").alias("ancestor_concept_name"),
                    F.lit(None).cast("long").alias("ancestor_concept_id"),
                    F.lit("").alias("descendant_concept_name"),
                    F.col("_parent").alias("descendant_concept_id")))


def fixed_roots(tree: DataFrame, roots: Sequence[tuple[int, str]]) -> DataFrame:
    """Named root rows in the form of :func:`tree_roots`."""
    return tree.sparkSession.createDataFrame(
        [("", None, name, node) for node, name in roots],
        "ancestor_concept_name string, ancestor_concept_id long, "
        "descendant_concept_name string, descendant_concept_id long")


def tree_export(tree: DataFrame, roots: Sequence[tuple[int, str]] | None = None) -> DataFrame:
    """Distinct edges plus root rows, ready for a CSV sink."""
    columns = ["ancestor_concept_name", "ancestor_concept_id",
               "descendant_concept_name", "descendant_concept_id"]
    top = tree_roots(tree) if roots is None else fixed_roots(tree, roots)
    return union_set([tree.select(*columns), top])


def follow_up_events(cohort: DataFrame, events: DataFrame, visits: DataFrame, domain: Domain,
                     days_delta: int, follow_months: int, max_date: date) -> DataFrame:
    """Cohort events with full follow-up that fall in [index + days, index + months)."""
    followed = cohort.filter(follow_up_possible("index_date", max_date, follow_months))
    return (cohort_events(followed, events, visits)
            .filter(in_follow_up("visit_start_date", "index_date", days_delta, follow_months))
            .withColumnRenamed(domain.concept_col, "node_concept_id"))


def _person_nodes(cohort: DataFrame, events: DataFrame, visits: DataFrame, domain: Domain,
                  days_delta: int, follow_months: int, max_date: date, *extra: str) -> DataFrame:
    """Distinct (person, concept): the pre-aggregate that keeps a frequent concept spread out."""
    by = _by_domain(domain)
    seen = events.select(*by, "person_id", "visit_occurrence_id", domain.concept_col)
    followed = cohort.select("person_id", "index_date", "pasc_flag", *extra)
    return (follow_up_events(followed, seen, visits, domain, days_delta, follow_months, max_date)
            .select(*by, "person_id", "pasc_flag", "node_concept_id", *extra).distinct())


def _only_nodes(counts: DataFrame, tree: DataFrame, domain: Domain) -> DataFrame:
    """Keep counted concepts that are tree nodes.

    The test runs on one row per concept, after counting, so the event table
    is never shuffled by concept.
    """
    keys = [*_by_domain(domain), "node_concept_id"]
    return counts.join(tree_nodes(tree).select(*keys), keys, "left_semi")


def _count_columns(case, total) -> list:
    return [total.alias("pop_count"), case.alias("case_count"),
            (total - case).alias("control_count")]


def node_counts(tree: DataFrame, cohort: DataFrame, events: DataFrame, visits: DataFrame,
                domain: Domain, days_delta: int, follow_months: int,
                max_date: date) -> DataFrame:
    """Distinct persons per exact node, split into cases and controls."""
    pairs = _person_nodes(cohort, events, visits, domain, days_delta, follow_months, max_date)
    cases = F.sum("pasc_flag").cast("long")
    by = _by_domain(domain)
    counts = pairs.groupBy(*by, "node_concept_id").agg(*_count_columns(cases, F.count("*")))
    return (_only_nodes(counts, tree, domain)
            .select(*by, F.col("node_concept_id").alias("node"), "node_concept_id",
                    "pop_count", "case_count", "control_count"))


def node_counts_by_fold(tree: DataFrame, cohort: DataFrame, events: DataFrame,
                        visits: DataFrame, domain: Domain, days_delta: int,
                        follow_months: int, max_date: date, folds: int = 5) -> DataFrame:
    """Counts for the whole cohort (``split`` = all) and every training set, in one pass.

    A training set is everyone minus one fold, so its counts are the node total
    minus the fold's own counts; no event row is copied per fold.
    """
    pairs = _person_nodes(cohort, events, visits, domain, days_delta, follow_months, max_date,
                          "fold")
    own, by = F.col("fold"), _by_domain(domain)
    per_node = pairs.groupBy(*by, "node_concept_id").agg(
        F.count("*").alias("pop"), F.sum("pasc_flag").cast("long").alias("cases"),
        *[F.count(F.when(own == i, 1)).alias(f"pop_{i}") for i in range(1, folds + 1)],
        *[F.sum(F.when(own == i, F.col("pasc_flag")).otherwise(0)).cast("long")
          .alias(f"cases_{i}") for i in range(1, folds + 1)])
    splits = [F.struct(F.lit("all").alias("split"), F.col("pop").alias("pop"),
                       F.col("cases").alias("cases"))]
    splits += [F.struct(F.lit(str(i)).alias("split"),
                        (F.col("pop") - F.col(f"pop_{i}")).alias("pop"),
                        (F.col("cases") - F.col(f"cases_{i}")).alias("cases"))
               for i in range(1, folds + 1)]
    return (_only_nodes(per_node, tree, domain)
            .select(*by, "node_concept_id", F.explode(F.array(*splits)).alias("s"))
            .filter("s.pop > 0")
            .select(*by, F.col("s.split").alias("split"), F.col("node_concept_id").alias("node"),
                    "node_concept_id",
                    *_count_columns(F.col("s.cases"), F.col("s.pop"))))


def significant(scan: DataFrame, threshold: CutThreshold) -> DataFrame:
    """Scanned nodes that pass the level, size and p-value thresholds."""
    return scan.filter(
        F.col("p_value").isNotNull()
        & compare(threshold.level_op, F.col("tree_level"), threshold.level)
        & compare(threshold.observations_op, F.col("observations"), threshold.observations)
        & compare(threshold.p_op, F.col("p_value"), threshold.p_value))


def select_cuts(scan: DataFrame, nodes: DataFrame, threshold: CutThreshold,
                by: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """Significant nodes with their label, ranked by log-likelihood ratio within ``by``.

    Cuts are tree nodes, whose number follows the vocabulary and not the persons, so a window
    ranks them.  With ``k`` only the best stay: tasks pass on at most ``k`` of a group before
    the shuffle, and labels are joined to what is left.
    """
    rank = F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(
        F.desc("log_likelihood_ratio"), F.asc("node_identifier"))).cast("long")
    ranked = significant(scan, threshold).withColumn("cut_rank", rank)
    if k is not None:
        ranked = ranked.filter(F.col("cut_rank") <= k)
    labels = nodes.withColumnRenamed("node_concept_id", "node_identifier")
    return ranked.join(labels, "node_identifier", "left")


def expand_cuts(cuts: DataFrame, concept: DataFrame, closure: DataFrame, domain: Domain,
                deduplicate: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """All descendants of every cut; or each descendant under the first cut covering it.

    "First" is the largest likelihood ratio, then the smallest node, found by one
    combinable minimum per descendant; the cuts need no rank for it.
    """
    by = list(by)
    own = _by_domain(domain)
    if not set(own) <= set(by):
        raise ValueError("stacked cuts are expanded by domain")
    order = [(-F.col("log_likelihood_ratio")).alias("_order")] if deduplicate else []
    known = concept.select(F.col("concept_id").alias("descendant_concept_id"))
    inside = domain_concepts(concept, domain).select(
        *own, F.col("concept_id").alias("ancestor_concept_id"))
    wanted = (cuts.select(*by, F.col("node_identifier").alias("ancestor_concept_id"), *order)
              .distinct().join(inside, [*own, "ancestor_concept_id"], "left_semi"))
    pairs = (closure.select("ancestor_concept_id", "descendant_concept_id")
             .join(wanted, "ancestor_concept_id")
             .join(known, "descendant_concept_id", "left_semi"))
    if not deduplicate:
        return pairs.select(*by, "ancestor_concept_id", "descendant_concept_id")
    first = F.min(F.struct("_order", "ancestor_concept_id"))
    return (pairs.groupBy(*by, "descendant_concept_id").agg(first.alias("_first"))
            .select(*by, F.col("_first.ancestor_concept_id").alias("ancestor_concept_id"),
                    "descendant_concept_id"))


def make_features(cuts: DataFrame, nodes: DataFrame, concept: DataFrame, closure: DataFrame,
                  domain: Domain, by: Sequence[str] = ()) -> DataFrame:
    """Feature definitions: every cut with its labelled descendants known to the tree."""
    pairs = expand_cuts(cuts, concept, closure, domain, by=by).filter(
        (F.col("ancestor_concept_id") != 0) & (F.col("descendant_concept_id") != 0))
    own = _by_domain(domain)
    label = {end: nodes.select(*own, F.col("node_concept_id").alias(f"{end}_concept_id"),
                               F.col("node_concept").alias(f"{end}_concept"))
             for end in ("ancestor", "descendant")}
    return (pairs.join(label["descendant"], [*own, "descendant_concept_id"])
            .join(label["ancestor"], [*own, "ancestor_concept_id"], "left")
            .filter(F.col("descendant_concept").isNotNull())
            .select(*by, "ancestor_concept_id", "ancestor_concept",
                    "descendant_concept_id", "descendant_concept").distinct())


def cut_overlap(cuts: DataFrame, fold_col: str = "fold") -> DataFrame:
    """How many nodes were selected in exactly which folds."""
    return (cuts.groupBy("node_identifier")
            .agg(F.array_join(F.sort_array(F.collect_set(F.col(fold_col).cast("string"))), ",")
                 .alias("folds"))
            .groupBy("folds").agg(F.count("*").alias("nodes")))
