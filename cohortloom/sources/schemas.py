"""Declared schemas of every input; nothing is inferred."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T.StructType([
        T.StructField(name, _TYPES[kind], True)
        for name, kind in (part.split() for part in ddl.split(","))])


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(),
          "date": T.DateType(), "timestamp": T.TimestampType(), "double": T.DoubleType(),
          "boolean": T.BooleanType()}

# Input tables and their columns.
CDM_TABLES = {
    "observation_derivation": _schema(
        "person_id long, visit_occurrence_id long, observation_date date, "
        "observation_concept_id long, value_as_concept_id long, "
        "observation_source_concept_id long"),
    "condition_occurrence": _schema(
        "condition_occurrence_id long, person_id long, visit_occurrence_id long, "
        "condition_concept_id long, condition_source_concept_id long, "
        "condition_source_value string"),
    "visit_occurrence": _schema(
        "visit_occurrence_id long, person_id long, visit_concept_id long, "
        "visit_start_date date"),
    "adt_occurrence": _schema("visit_occurrence_id long, service_concept_id long"),
    "measurement_labs": _schema(
        "person_id long, visit_occurrence_id long, measurement_concept_id long"),
    "procedure_occurrence": _schema(
        "person_id long, visit_occurrence_id long, procedure_concept_id long"),
    "drug_exposure": _schema(
        "person_id long, visit_occurrence_id long, drug_concept_id long, "
        "drug_exposure_start_date date"),
    "person": _schema(
        "person_id long, birth_date date, birth_datetime timestamp, site string, "
        "gender_concept_id long, race_concept_id long, ethnicity_concept_id long"),
}

VOCABULARY_TABLES = {
    "concept": _schema(
        "concept_id long, concept_name string, concept_code string, vocabulary_id string, "
        "domain_id string, concept_class_id string, invalid_reason string"),
    "concept_ancestor": _schema(
        "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int"),
    "concept_relationship": _schema(
        "concept_id_1 long, concept_id_2 long, relationship_id string, invalid_reason string"),
}

CODESET = _schema("concept_id long, concept_name string, concept_code string, "
                  "vocabulary_id string")
RAW_CODES = _schema("code string, description string")
RULES = _schema("condition_concept_id long, condition_source_concept_id long, "
                "condition_source_value string, action string")
CLUSTERS = _schema("concept_id long, cluster string")
STD_CONCEPTS = _schema(
    "source_concept_id long, std_concept_id long, std_concept_name string, "
    "std_concept_code string, std_vocabulary_id string, orig_code string, "
    "source_vocabulary_id string, orig_description string")
# Header of the tree-scan result file, in file order.
SCAN_HEADER = ("Cut.No.", "Node.Identifier", "Tree.Level", "Relative.Risk",
               "Log.Likelihood.Ratio", "Observations", "Expected", "P.value")
SCAN = _schema("cut_no int, node_identifier long, tree_level int, relative_risk double, "
               "log_likelihood_ratio double, observations long, expected double, "
               "p_value double")

# One-letter column types of codeset files.
_LETTERS = {"i": "long", "c": "string", "d": "double", "D": "date", "l": "boolean"}


def column_types(letters: str, names: Sequence[str]) -> T.StructType:
    """Schema from one type letter per column."""
    if len(letters) != len(names):
        raise ValueError(f"{len(letters)} types for {len(names)} columns")
    return T.StructType([T.StructField(n, _TYPES[_LETTERS[c]], True)
                         for n, c in zip(names, letters)])
