"""Clinical-model views over an order/line-item star schema.

Orders are visits, line items are condition, drug, lab or procedure events,
customers are persons and the part catalogue gives the vocabularies.  All ids
are arithmetic or md5-based, so no view needs a global number and any engine
can rebuild them.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.config import DOMAINS, STACKED, CutThreshold, PhenotypeConfig
from cohortloom.functions.hashing import hash32
from cohortloom.functions.dates import follow_up_possible, in_follow_up

_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}

# Every vocabulary owns a range of ids; inside it leaves, groups and the root.
ID_RANGE = 1_000_000_000_000
GROUPS = 500_000_000_000
ROOT = 900_000_000_000
DOMAIN_NUMBER = {"cond": 1, "drug": 2, "lab": 3, "proc": 4}
SOURCE_NUMBER, SOURCE_10_NUMBER = 5, 6



def group_id_of(domain: str, text: str) -> int:
    """Group id on the driver, for settings and column lists."""
    digest = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    return DOMAIN_NUMBER[domain] * ID_RANGE + GROUPS + digest


PROMO_NODE = group_id_of("cond", "t|PROMO")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
BRANDS = tuple(f"Brand#{i}" for i in range(1, 26))

STAR_CONFIG = replace(
    PhenotypeConfig(),
    min_date=date(1995, 1, 1),
    max_date=date(2001, 8, 1),
    entry_periods=tuple((f"y{y}", f"{y}-01", f"{y}-12") for y in range(1995, 2002)),
    excluded_clusters=("Brand#1", "Brand#2"),
    leak_text_pattern="ring$",
    leak_root=PROMO_NODE,
    cut_thresholds={name: CutThreshold(1, 2, level_op=">", p_value=0.01)
                    for name in ("cond", "lab", "proc", "drug", "stacked")},
)


def leaf_id(domain: str, part: Column) -> Column:
    return F.lit(DOMAIN_NUMBER[domain] * ID_RANGE + 1) + part


def group_id(domain: str, text: Column) -> Column:
    return F.lit(DOMAIN_NUMBER[domain] * ID_RANGE + GROUPS) + hash32(text)


def root_id(domain: str) -> int:
    return DOMAIN_NUMBER[domain] * ID_RANGE + ROOT


class StarTables:
    """Lazy clinical views over one folder of star-schema Parquet files."""

    def __init__(self, spark: SparkSession, folder: str,
                 cfg: PhenotypeConfig = STAR_CONFIG):
        self.spark = spark
        self.folder = folder
        self.cfg = cfg

    def base(self, name: str) -> DataFrame:
        """A driver table, with a declared schema."""
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    # facts -------------------------------------------------------------------
    @cached_property
    def visits(self) -> DataFrame:
        # Visit concepts by the first digit of the priority.
        digit = F.substring("o_orderpriority", 1, 1)
        concept = (F.when(digit == "1", 9203).when(digit == "2", 9201).when(digit == "3", 9202)
                   .when(digit == "4", 44814711).otherwise(0)).cast("long")
        return self.base("orders").select(
            F.col("o_orderkey").alias("visit_occurrence_id"),
            F.col("o_custkey").alias("person_id"),
            concept.alias("visit_concept_id"),
            F.to_date("o_orderdate").alias("visit_start_date"))

    @cached_property
    def adt(self) -> DataFrame:
        return (self.base("orders").filter("o_orderstatus = 'F'")
                .select(F.col("o_orderkey").alias("visit_occurrence_id"),
                        F.lit(2000000079).cast("long").alias("service_concept_id")))

    @cached_property
    def _lines(self) -> DataFrame:
        """Line items with an event id and their order's person and date."""
        cents = [F.floor(F.col(c) * 100 + 0.5).cast("string")
                 for c in ("l_extendedprice", "l_discount", "l_tax")]
        event_id = F.md5(F.concat_ws(
            "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.col("l_quantity").cast("int").cast("string"), *cents, "l_returnflag",
            "l_linestatus", F.to_date("l_shipdate").cast("string")))
        orders = self.base("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person_id"),
            F.to_date("o_orderdate").alias("event_date"))
        return (self.base("lineitem").withColumn("event_id", event_id)
                .join(orders, "l_orderkey")
                .withColumnRenamed("l_orderkey", "visit_occurrence_id"))

    def _domain_lines(self, domain: str) -> DataFrame:
        where = {"cond": "l_returnflag = 'R'", "drug": "l_returnflag = 'A'",
                 "lab": "l_returnflag = 'N' AND l_linestatus = 'O'",
                 "proc": "l_returnflag = 'N' AND l_linestatus = 'F'"}[domain]
        return self._lines.filter(where).withColumn(
            "concept_id", leaf_id(domain, F.col("l_partkey")))

    @cached_property
    def conditions(self) -> DataFrame:
        names = self.base("part").select(F.col("p_partkey").alias("l_partkey"),
                                         F.col("p_name").alias("condition_source_value"))
        return (self._domain_lines("cond").join(names, "l_partkey")
                .select(F.col("event_id").alias("condition_occurrence_id"), "person_id",
                        "visit_occurrence_id", F.col("concept_id").alias("condition_concept_id"),
                        F.col("concept_id").alias("condition_source_concept_id"),
                        "condition_source_value"))

    @cached_property
    def drugs(self) -> DataFrame:
        return self._domain_lines("drug").select(
            "person_id", "visit_occurrence_id", F.col("concept_id").alias("drug_concept_id"),
            F.col("event_date").alias("drug_exposure_start_date"))

    @cached_property
    def labs(self) -> DataFrame:
        return self._domain_lines("lab").select(
            "person_id", "visit_occurrence_id",
            F.col("concept_id").alias("measurement_concept_id"))

    @cached_property
    def procedures(self) -> DataFrame:
        return self._domain_lines("proc").select(
            "person_id", "visit_occurrence_id",
            F.col("concept_id").alias("procedure_concept_id"))

    def events(self, domain: str) -> DataFrame:
        return getattr(self, {"cond": "conditions", "drug": "drugs", "lab": "labs",
                              "proc": "procedures", STACKED.name: "stacked_events"}[domain])

    @cached_property
    def stacked_events(self) -> DataFrame:
        """All four event types from one scan, in the form of :func:`stack_events`."""
        flag, status, part = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey")
        domain = (F.when(flag == "R", "cond").when(flag == "A", "drug")
                  .when((flag == "N") & (status == "O"), "lab")
                  .when((flag == "N") & (status == "F"), "proc"))
        concept = F.coalesce(*[F.when(F.col("domain") == d, leaf_id(d, part))
                               for d in DOMAIN_NUMBER])
        return (self._lines.withColumn("domain", domain).filter(F.col("domain").isNotNull())
                .select("domain", "person_id", "visit_occurrence_id",
                        concept.alias("concept_id"),
                        F.when(F.col("domain") == "cond", F.col("event_id")).alias("event_id")))

    @cached_property
    def observations(self) -> DataFrame:
        cfg = self.cfg
        quantity = F.col("l_quantity")
        kinds = self.base("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
        concept = (F.when(quantity == 1, cfg.pcr_concept).when(quantity == 2, cfg.antigen_concept)
                   .when(quantity == 3, cfg.serology_concept).otherwise(cfg.diagnosis_concept))
        positive = F.when(F.col("l_linestatus") == "F", cfg.positive_values[1]).otherwise(
            cfg.positive_values[0])
        value = (F.when(quantity < 50, positive)
                 .when(F.col("p_type") == "PROMO", cfg.diagnosis_a_value)
                 .when(F.col("p_type") == "ECONOMY", cfg.diagnosis_b_value))
        return (self._lines.filter(quantity.isin(1.0, 2.0, 3.0, 50.0)).join(kinds, "l_partkey")
                .select("person_id", "visit_occurrence_id",
                        F.col("event_date").alias("observation_date"),
                        concept.cast("long").alias("observation_concept_id"),
                        value.cast("long").alias("value_as_concept_id"),
                        F.col("event_id").alias("observation_source_concept_id"))
                .filter(F.col("value_as_concept_id").isNotNull()))

    @cached_property
    def person(self) -> DataFrame:
        birth = F.date_add(F.lit(date(1976, 1, 1)), (F.col("c_custkey") * 37 % 6000).cast("int"))
        third = F.col("c_custkey") % 3
        segment = F.col("c_mktsegment")
        gender = F.when(third == 0, 8507).when(third == 1, 8532).otherwise(0)
        race = (F.when(segment == "AUTOMOBILE", 8527).when(segment == "BUILDING", 8516)
                .when(segment == "FURNITURE", 8515).when(segment == "HOUSEHOLD", 44814659)
                .otherwise(0))
        ethnicity = F.when(F.col("c_nationkey") % 7 == 0, 38003563).otherwise(0)
        nations = self.base("nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                             F.col("n_regionkey").alias("r_regionkey"))
        return (self.base("customer").join(nations, "c_nationkey")
                .join(self.base("region"), "r_regionkey")
                .select(F.col("c_custkey").alias("person_id"), birth.alias("birth_date"),
                        birth.cast("timestamp").alias("birth_datetime"),
                        F.col("r_name").alias("site"),
                        gender.cast("long").alias("gender_concept_id"),
                        race.cast("long").alias("race_concept_id"),
                        ethnicity.cast("long").alias("ethnicity_concept_id")))

    # vocabularies ----------------------------------------------------------------
    @cached_property
    def _part(self) -> DataFrame:
        return self.base("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")

    @cached_property
    def _hashed_part(self) -> DataFrame:
        """Parts with the hashes of their groups, taken once for all domains."""
        return (self._part
                .withColumn("brand_key", F.concat(F.lit("b|"), "p_type", F.lit("|"), "p_brand"))
                .withColumn("type_key", F.concat(F.lit("t|"), "p_type"))
                .withColumn("brand_hash", hash32(F.col("brand_key")))
                .withColumn("type_hash", hash32(F.col("type_key"))))

    @cached_property
    def _hashed_groups(self) -> DataFrame:
        """One row per (type, brand); as many as the catalogue has groups."""
        return self._hashed_part.select("p_type", "p_brand", "brand_key", "type_key",
                                        "brand_hash", "type_hash").distinct()

    @staticmethod
    def _ids(name: str) -> tuple[Column, Column, Column, Column]:
        """(leaf, brand group, type group, root) ids of a domain over hashed parts."""
        groups = F.lit(DOMAIN_NUMBER[name] * ID_RANGE + GROUPS)
        return (leaf_id(name, F.col("p_partkey")), groups + F.col("brand_hash"),
                groups + F.col("type_hash"), F.lit(root_id(name)))

    @cached_property
    def concept(self) -> DataFrame:
        """Leaf, brand group, type group and root of every domain, and source codes.

        Some source codes are invalid, some occur in two vocabularies.
        """
        def row(concept_id, name, code, vocabulary, domain_id, kind, reason=None):
            reason = F.lit(None).cast("string") if reason is None else reason
            return F.struct(
                concept_id.cast("long").alias("concept_id"), name.alias("concept_name"),
                code.alias("concept_code"), vocabulary.alias("vocabulary_id"),
                F.lit(domain_id).alias("domain_id"), F.lit(kind).alias("concept_class_id"),
                reason.alias("invalid_reason"))

        part_text = F.col("p_partkey").cast("string")
        leaves, groups = [], []
        for domain in DOMAINS.values():
            leaf, brand, kind, root = self._ids(domain.name)
            top = F.lit(domain.vocabularies[-1])
            mixed = F.get(F.array(*[F.lit(v) for v in domain.vocabularies]),
                          (F.col("p_partkey") % len(domain.vocabularies)).cast("int"))
            leaves.append(row(leaf, F.col("p_name"), F.concat(F.lit("P"), part_text), mixed,
                              domain.domain_id, "Leaf"))
            groups += [
                row(brand, F.concat("p_type", F.lit("_"), "p_brand"), F.col("brand_key"), top,
                    domain.domain_id, "Ingredient" if domain.name == "drug" else "Group"),
                row(kind, F.col("p_type"), F.col("type_key"), top, domain.domain_id, "Group"),
                row(root, F.lit(f"All {domain.domain_id}"), F.lit("root"), top,
                    domain.domain_id, "Root")]
        size = F.col("p_size")
        for number, vocabulary, present in (
                (SOURCE_NUMBER, "ICD10CM", F.lit(True)),
                (SOURCE_10_NUMBER, "ICD10", size % 5 == 1)):
            source = F.when(present, F.col("p_partkey") + F.lit(number * ID_RANGE + 1))
            leaves.append(row(source, F.concat(F.lit("src "), "p_name"),
                              F.concat(F.lit("S"), part_text), F.lit(vocabulary), "Condition",
                              "Code", F.when(size % 10 == 0, "D")))
        below = (self._part.select(F.explode(F.array(*leaves)).alias("r")).select("r.*")
                 .filter(F.col("concept_id").isNotNull()))
        above = (self._hashed_groups.select(F.explode(F.array(*groups)).alias("r"))
                 .select("r.*").distinct())
        return below.unionByName(above)

    @cached_property
    def concept_ancestor(self) -> DataFrame:
        """Closure root - type - (type, brand) - part, self rows included."""
        def row(path, below, above):
            return F.struct(path[above].cast("long").alias("ancestor_concept_id"),
                            path[below].cast("long").alias("descendant_concept_id"),
                            F.lit(above - below).alias("min_levels_of_separation"))

        paths = [self._ids(name) for name in DOMAINS]
        leaves = [row(p, 0, above) for p in paths for above in range(4)]
        groups = [row(p, below, above) for p in paths
                  for below in range(1, 4) for above in range(below, 4)]
        return (self._hashed_part.select(F.explode(F.array(*leaves)).alias("r")).select("r.*")
                .unionByName(self._hashed_groups.select(F.explode(F.array(*groups)).alias("r"))
                             .select("r.*").distinct()))

    @cached_property
    def concept_relationship(self) -> DataFrame:
        """Source codes map to leaves; some relations are invalid, some codes map twice."""
        size = F.col("p_size")
        source = F.col("p_partkey") + F.lit(SOURCE_NUMBER * ID_RANGE + 1)
        leaf, brand, _, _ = self._ids("cond")
        invalid = F.when(size % 10 == 2, "D")

        def row(a, b, relation, reason):
            return F.struct(a.alias("concept_id_1"), b.alias("concept_id_2"),
                            F.lit(relation).alias("relationship_id"),
                            reason.cast("string").alias("invalid_reason"))

        rows = F.array(row(source, leaf, "Maps to", invalid),
                       row(source, F.when(size % 10 == 3, brand), "Maps to", F.lit(None)),
                       row(leaf, source, "Mapped from", invalid))
        return (self._hashed_part.select(F.explode(rows).alias("r")).select("r.*")
                .filter(F.col("concept_id_2").isNotNull()))

    @cached_property
    def raw_codes(self) -> DataFrame:
        """Codes with a description that may name its vocabulary."""
        suffix = F.when(F.col("p_size") % 4 == 0, "").when(
            F.col("p_size") % 4 == 1, " (SNOMED) ").otherwise(" (ICD10CM)")
        return self._part.select(
            F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("code"),
            F.concat("p_name", suffix).alias("description"))

    @cached_property
    def rules(self) -> DataFrame:
        size = F.col("p_size")
        action = F.when(size >= 45, "pasc").when(size >= 40, "drop").otherwise("ignore")
        leaf = leaf_id("cond", F.col("p_partkey"))
        return (self._part.filter("p_type = 'LARGE' AND p_size >= 35")
                .select(leaf.alias("condition_concept_id"),
                        leaf.alias("condition_source_concept_id"),
                        F.col("p_name").alias("condition_source_value"),
                        action.alias("action")))

    @cached_property
    def clusters(self) -> DataFrame:
        return self._part.select(leaf_id("cond", F.col("p_partkey")).alias("concept_id"),
                                 F.col("p_brand").alias("cluster"))

    def codeset(self, domain: str = "cond") -> DataFrame:
        """The type groups of a domain as a code list."""
        kind = F.concat(F.lit("t|"), "p_type")
        return (self._part.select("p_type").distinct()
                .select(group_id(domain, kind).alias("concept_id"),
                        F.col("p_type").alias("concept_name"), kind.alias("concept_code"),
                        F.lit(DOMAINS[domain].vocabularies[-1]).alias("vocabulary_id")))

    # stand-ins for external results -----------------------------------------------
    def scan(self, cohort: DataFrame, domain: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Tree-scan-shaped rows for the type and brand groups: persons rolled up to them."""
        cfg = self.cfg
        stacked = domain == STACKED.name
        dom = STACKED if stacked else DOMAINS[domain]
        groups = []
        for name in DOMAINS if stacked else [domain]:
            leaf, brand, kind, _ = self._ids(name)
            groups += [F.struct(leaf.alias(dom.concept_col), node.alias("node"),
                                F.lit(level).alias("level"))
                       for node, level in ((brand, 2), (kind, 1))]
        above = self._hashed_part.select(F.explode(F.array(*groups)).alias("g")).select("g.*")
        by = (*by, "domain") if stacked else by
        members = cohort.select("person_id", "pasc_flag", "index_date",
                                *[c for c in by if c != "domain"]).filter(
            follow_up_possible("index_date", cfg.max_date, cfg.follow_months))
        pairs = (self.events(domain).select("person_id", "visit_occurrence_id", dom.concept_col,
                                            *[c for c in by if c == "domain"])
                 .join(members, "person_id")
                 .join(self.visits.select("visit_occurrence_id", "visit_start_date"),
                       "visit_occurrence_id")
                 .filter(in_follow_up("visit_start_date", "index_date", cfg.days_delta,
                                      cfg.follow_months))
                 .join(above, dom.concept_col)
                 .select(*by, "person_id", "pasc_flag", "node", "level").distinct())
        share = F.col("cases") / F.col("persons")
        return (pairs.groupBy(*by, "node", "level")
                .agg(F.count("*").alias("persons"), F.sum("pasc_flag").alias("cases"))
                .select(*by, (F.col("node") % 1000003).cast("int").alias("cut_no"),
                        F.col("node").alias("node_identifier"),
                        F.col("level").alias("tree_level"),
                        F.round(share / 0.25, 6).alias("relative_risk"),
                        F.round(share, 6).alias("log_likelihood_ratio"),
                        F.col("persons").alias("observations"),
                        (F.col("persons") * 0.25).alias("expected"),
                        F.when(share > 0.4, 0.001).when(share > 0.1, 0.5).alias("p_value")))

    @cached_property
    def predictions(self) -> DataFrame:
        """Class probabilities per order with many ties, informative about the class."""
        y = (F.col("o_orderkey") % 3).cast("int")

        def percent(tag, lift):
            h = hash32(F.concat(F.col("o_orderkey").cast("string"), F.lit(tag)))
            return F.least(F.lit(49), (h % 40) + F.when(y == lift, 12).otherwise(0)) / 100.0

        rows = self.base("orders").select(
            F.col("o_orderkey").alias("person_id"), (F.col("o_orderkey") % 5 + 1).cast("int")
            .alias("fold"), y.alias("y3"), percent("a", 1).alias("p1"),
            percent("b", 2).alias("p2"))
        return rows.withColumn("p0", 1 - F.col("p1") - F.col("p2"))
