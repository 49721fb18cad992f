"""The study over the star mapping, as lazy pieces shared by the registered queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.config import DOMAINS, STACKED, CutThreshold
from cohortloom.functions.distributed import stored
from cohortloom.operators import assemble, cohort, events, hierarchy, windows
from cohortloom.plans import study as plans
from cohortloom.session import configure
from cohortloom.sources.star_mapping import PROMO_NODE, STAR_CONFIG, StarTables

# Type groups (level 1) as features: a closed set, for wide tables.
TYPE_THRESHOLD = CutThreshold(1, 1, p_value=1.0, p_op="<=")


def domain_of(name: str):
    return STACKED if name == STACKED.name else DOMAINS[name]


class Study:
    """Cohort funnel, trees, cuts, features and event sets; nothing runs until used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.cdm = StarTables(spark, folder)
        self.cfg = STAR_CONFIG

    # funnel -----------------------------------------------------------------------
    @cached_property
    def base_cohort(self) -> DataFrame:
        return cohort.base_cohort(self.cdm.observations, self.cfg.max_date, self.cfg)

    @cached_property
    def adjusted(self) -> DataFrame:
        return cohort.make_cohort(self.cdm.observations, self.cdm.conditions, self.cdm.visits,
                                  self.cdm.rules, self.cfg.max_date, self.cfg)

    @cached_property
    def followed(self) -> DataFrame:
        return cohort.filter_visits(self.adjusted, self.cdm.visits, self.cfg.n_visits)

    @cached_property
    def imputed(self) -> DataFrame:
        return cohort.impute_dates(self.followed, self.cfg.min_window, self.cfg.max_window,
                                   self.cfg.impute_seed)

    @cached_property
    def demo(self) -> DataFrame:
        return cohort.join_cohort_demo(self.imputed, self.cdm.person, self.cfg)

    @cached_property
    def dated(self) -> DataFrame:
        return cohort.filter_dates(self.demo, self.cfg.min_date, self.cfg.max_date)

    @cached_property
    def cohort(self) -> DataFrame:
        return cohort.get_cohort_entry_period(self.dated, self.cfg)

    @cached_property
    def cohort_table(self) -> DataFrame:
        """The study cohort written once: later steps read it several times."""
        return stored(self.cohort)

    @cached_property
    def folded(self) -> DataFrame:
        return cohort.split_cohort(self.cohort_table, self.cfg.folds, self.cfg.seed)

    # hierarchy ----------------------------------------------------------------------
    def full_tree(self, domain: str) -> DataFrame:
        return hierarchy.make_tree(self.cdm.concept, self.cdm.concept_ancestor, DOMAINS[domain])

    def tree(self, domain: str) -> DataFrame:
        prune = PROMO_NODE if domain in ("cond", STACKED.name) else None
        return hierarchy.make_tree(self.cdm.concept, self.cdm.concept_ancestor,
                                   domain_of(domain), prune)

    def nodes(self, domain: str) -> DataFrame:
        return hierarchy.tree_nodes(self.tree(domain))

    def counts(self, domain: str) -> DataFrame:
        return hierarchy.node_counts(
            self.tree(domain), self.cohort_table, self.cdm.events(domain), self.cdm.visits,
            DOMAINS[domain], self.cfg.days_delta, self.cfg.follow_months, self.cfg.max_date)

    def counts_by_fold(self, domain: str) -> DataFrame:
        return hierarchy.node_counts_by_fold(
            self.tree(domain), self.folded, self.cdm.events(domain), self.cdm.visits,
            domain_of(domain), self.cfg.days_delta, self.cfg.follow_months, self.cfg.max_date,
            self.cfg.folds)

    def scan(self, domain: str) -> DataFrame:
        return self.cdm.scan(self.cohort_table, domain)

    def fold_scan(self, domain: str) -> DataFrame:
        """Scans of the training set of every fold."""
        train = cohort.fold_memberships(self.folded, self.cfg.folds).filter("part = 'train'")
        return self.cdm.scan(train, domain, by=("fold",))

    def cuts(self, domain: str) -> DataFrame:
        return hierarchy.significant(self.scan(domain), self.cfg.cut_thresholds[domain])

    def fold_cuts(self, domain: str) -> DataFrame:
        return hierarchy.significant(self.fold_scan(domain), self.cfg.cut_thresholds[domain])

    def type_cuts(self, domain: str) -> DataFrame:
        return hierarchy.significant(self.scan(domain).filter("tree_level = 1"), TYPE_THRESHOLD)

    def _features(self, cuts: DataFrame, domain: str, by=(), nodes: DataFrame | None = None):
        return hierarchy.make_features(
            cuts, self.nodes(domain) if nodes is None else nodes, self.cdm.concept,
            self.cdm.concept_ancestor, domain_of(domain), by)

    def features(self, domain: str) -> DataFrame:
        by = ("domain",) if domain == STACKED.name else ()
        return self._features(self.cuts(domain), domain, by)

    def fold_features(self, domain: str) -> DataFrame:
        by = ("fold", "domain") if domain == STACKED.name else ("fold",)
        return self._features(self.fold_cuts(domain), domain, by)

    @cached_property
    def fold_feature_table(self) -> DataFrame:
        """Definitions of every fold and of the whole cohort (fold 0), written once."""
        whole = self.features(STACKED.name).withColumn("fold", F.lit(0))
        return stored(self.fold_features(STACKED.name).unionByName(whole))

    def type_features(self, domain: str) -> DataFrame:
        return self._features(self.type_cuts(domain), domain)

    def unpruned_type_features(self, domain: str) -> DataFrame:
        return self._features(self.type_cuts(domain), domain,
                              nodes=hierarchy.tree_nodes(self.full_tree(domain)))

    # events ---------------------------------------------------------------------------
    def feature_events(self, domain: str, features: DataFrame | None = None) -> DataFrame:
        return events.feature_events(
            self.folded, self.features(domain) if features is None else features,
            self.cdm.events(domain), self.cdm.visits, DOMAINS[domain], self.cfg.days_delta)

    def feature_long(self, domain: str, features: DataFrame | None = None,
                     ids=windows.IDS, members: DataFrame | None = None) -> DataFrame:
        return windows.feature_long(
            self.folded if members is None else members, domain_of(domain),
            self.features(domain) if features is None else features, self.cdm.events(domain),
            self.cdm.visits, self.cdm.observations, self.cfg.days_delta, cfg=self.cfg, ids=ids)

    @cached_property
    def util(self) -> DataFrame:
        return events.get_util(self.folded, self.cdm.visits, self.cdm.adt, self.cfg.days_delta,
                               self.cfg)

    @cached_property
    def lab_cts(self) -> DataFrame:
        return events.get_lab_cts(self.folded, self.cdm.labs, self.cdm.visits,
                                  self.cfg.days_delta)

    # model input ------------------------------------------------------------------------
    def blocks(self, ids=windows.COHORT_IDS, features: DataFrame | None = None
               ) -> dict[str, DataFrame]:
        """Long feature blocks of the whole cohort."""
        return {STACKED.name: self.feature_long(STACKED.name, features, ids=ids),
                "util": windows.util_long(self.util, ids=ids),
                "lab_cts": windows.lab_count_long(self.lab_cts, ids=ids)}

    @cached_property
    def long(self) -> DataFrame:
        return assemble.assemble_long(self.folded, self.blocks())

    @cached_property
    def fold_long_table(self) -> DataFrame:
        """Stored rows of the features of any fold; they carry the person's fold.

        Definitions differ by fold, but a person's events do not: one pass finds all.
        """
        ids = ("person_id", "fold")
        every = self.fold_feature_table.drop("fold").distinct()
        return stored(assemble.assemble_long(self.folded, self.blocks(ids, every), ("fold",)))

    def defined(self, fold: int) -> DataFrame:
        """Feature rows as a fold's own cuts define them (0: those of the whole cohort)."""
        return plans.restrict_to(self.fold_long_table,
                                 self.fold_feature_table.filter(F.col("fold") == fold))

    @cached_property
    def labelled(self) -> DataFrame:
        return self.folded.withColumn("label", assemble.label3())

    @cached_property
    def long_table(self) -> DataFrame:
        """Feature rows written once, for steps that read them several times."""
        return stored(self.long)

    def split(self, fold: int) -> tuple[DataFrame, DataFrame]:
        """Train and test feature rows of a fold; its features come from its training part."""
        of = self.defined(fold)
        return (cohort.fold_train(of, fold).drop("fold"),
                cohort.fold_test(of, fold).drop("fold"))
