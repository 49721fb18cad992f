"""Code lists: reading, lookup, standardisation, expansion and merging."""

from __future__ import annotations

from typing import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.distributed import union_set
from cohortloom.functions.text import vocabulary_suffix
from cohortloom.operators.columns import rename_matching
from cohortloom.sources.files import read_csv, write_csv
from cohortloom.sources.schemas import CODESET, RAW_CODES, STD_CONCEPTS, column_types


def read_codeset(spark: SparkSession, path: str, col_types: str | None = None,
                 names: Sequence[str] | None = None) -> DataFrame:
    """Typed CSV with a header; ``col_types`` uses one letter per column (i, c, d, D, l)."""
    schema = CODESET if col_types is None else column_types(
        col_types, names or [f.name for f in CODESET.fields])
    return read_csv(spark, path, schema)


def load_codeset(spark: SparkSession, path: str, table_name: str,
                 col_types: str | None = None,
                 names: Sequence[str] | None = None) -> DataFrame:
    """Read once, register under a name and keep for reuse.

    A list is known by its name, file and types; other tables of that name are never
    taken for it, and another file under the name replaces it.
    """
    known = (path, col_types, tuple(names or ()))
    lists = _loaded.setdefault(spark, {})
    if lists.get(table_name, (None,))[0] != known:
        codes = read_codeset(spark, path, col_types, names).cache()
        codes.createOrReplaceTempView(table_name)
        lists[table_name] = (known, codes)
    return lists[table_name][1]


# Code lists of each session: name -> (file and types, rows).
_loaded: WeakKeyDictionary = WeakKeyDictionary()


def get_descendants(codeset: DataFrame, concept: DataFrame, closure: DataFrame) -> DataFrame:
    """Concept rows at or below the concepts of a codeset."""
    below = (closure.join(codeset.select(F.col("concept_id").alias("ancestor_concept_id")),
                          "ancestor_concept_id", "left_semi")
             .select(F.col("descendant_concept_id").alias("concept_id")).distinct())
    return (concept.join(below, "concept_id", "left_semi")
            .select("concept_id", "concept_name", "concept_code", "vocabulary_id").distinct())


def find_concepts_from_codes(codes: DataFrame, concept: DataFrame,
                             vocabularies: Sequence[str] | DataFrame) -> DataFrame:
    """Valid concepts whose code is listed and whose vocabulary is a candidate."""
    valid = concept.filter(F.col("invalid_reason").isNull())
    if isinstance(vocabularies, DataFrame):
        valid = valid.join(vocabularies.select(F.col(vocabularies.columns[0])
                                               .alias("vocabulary_id")),
                           "vocabulary_id", "left_semi")
    else:
        valid = valid.filter(F.col("vocabulary_id").isin(*vocabularies))
    listed = codes.select(F.col("code").alias("concept_code"), "description")
    return valid.join(listed, "concept_code").select(
        "concept_code", "description", "concept_id", "concept_name", "vocabulary_id")


def find_concepts_from_cids(cids: DataFrame, concept: DataFrame,
                            valid_only: bool = False) -> DataFrame:
    """Concept rows of listed ids, described by their name."""
    if valid_only:
        concept = concept.filter(F.col("invalid_reason").isNull())
    return concept.join(cids.select("concept_id"), "concept_id").select(
        "concept_id", "concept_name", "concept_code", "vocabulary_id",
        F.col("concept_name").alias("description"))


def standardize_concepts(concepts: DataFrame, concept: DataFrame,
                         relationship: DataFrame) -> DataFrame:
    """Follow valid 'Maps to' relations; original code, vocabulary and description stay."""
    original = concepts.select(
        F.col("concept_id").alias("source_concept_id"),
        F.col("concept_code").alias("orig_code"),
        F.col("vocabulary_id").alias("source_vocabulary_id"),
        F.col("description").alias("orig_description"))
    mapping = (relationship.filter((F.col("relationship_id") == "Maps to")
                                   & F.col("invalid_reason").isNull())
               .select(F.col("concept_id_1").alias("source_concept_id"),
                       F.col("concept_id_2").alias("std_concept_id")))
    wanted = original.select("source_concept_id").distinct()
    standard = concept.select(
        F.col("concept_id").alias("std_concept_id"),
        F.col("concept_name").alias("std_concept_name"),
        F.col("concept_code").alias("std_concept_code"),
        F.col("vocabulary_id").alias("std_vocabulary_id"))
    mapped = (mapping.join(wanted, "source_concept_id", "left_semi").distinct()
              .join(standard, "std_concept_id").distinct())
    return mapped.join(original, "source_concept_id").select(
        "source_concept_id", "std_concept_id", "std_concept_name", "std_concept_code",
        "std_vocabulary_id", "orig_code", "source_vocabulary_id", "orig_description")


def expand_codeset(std_concepts: DataFrame, concept: DataFrame,
                   closure: DataFrame) -> DataFrame:
    """Descendants of standard concepts, each with the ancestor it came from."""
    probe = std_concepts.select(F.col("std_concept_id").alias("ancestor_concept_id"),
                                F.col("std_concept_name").alias("ancestor_concept_name"))
    found = concept.select(
        F.col("concept_id").alias("std_concept_id"),
        F.col("concept_name").alias("std_concept_name"),
        F.col("concept_code").alias("std_concept_code"),
        F.col("vocabulary_id").alias("std_vocabulary_id"))
    pairs = (closure.select("ancestor_concept_id",
                            F.col("descendant_concept_id").alias("std_concept_id"))
             .join(probe.select("ancestor_concept_id"), "ancestor_concept_id", "left_semi"))
    return (pairs.join(found, "std_concept_id").distinct()
            .join(probe, "ancestor_concept_id")
            .select("std_concept_id", "std_concept_name", "std_concept_code",
                    "std_vocabulary_id", "ancestor_concept_id", "ancestor_concept_name"))


def infer_vocabularies(raw_codes: DataFrame) -> DataFrame:
    """Vocabularies named at the end of descriptions; ICD10 joins ICD10CM."""
    named = (raw_codes.select(vocabulary_suffix().alias("vocabulary_id"))
             .filter(F.col("vocabulary_id").isNotNull()).distinct())
    partner = (named.filter(F.col("vocabulary_id") == "ICD10CM")
               .select(F.lit("ICD10").alias("vocabulary_id")))
    return union_set([named, partner])


def process_codes(codes: DataFrame, concept: DataFrame, relationship: DataFrame,
                  vocabularies: Sequence[str] | DataFrame
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, standardized, metrics): lookup, mapping and a row of progress counts each."""
    found = find_concepts_from_codes(codes, concept, vocabularies)
    mapped = standardize_concepts(found, concept, relationship)
    counts = {"Source codes": codes, "Source concepts": found,
              "Mapped concepts": mapped.select("source_concept_id"),
              "Standard concepts": mapped.select("std_concept_id")}
    metrics = union_set([
        df.distinct().agg(F.lit(name).alias("metric"), F.count("*").alias("n"))
        for name, df in counts.items()])
    return found, mapped, metrics


def process_codes_from_file(spark: SparkSession, path: str, concept: DataFrame,
                            relationship: DataFrame,
                            vocabularies: Sequence[str] | None = None
                            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Process a CSV of codes and write both results next to it."""
    codes = read_csv(spark, path, RAW_CODES)
    found, mapped, metrics = process_codes(
        codes, concept, relationship,
        infer_vocabularies(codes) if vocabularies is None else vocabularies)
    stem = path.removesuffix(".csv")
    write_csv(found, f"{stem}_src_concepts.csv")
    write_csv(mapped, f"{stem}_mapped.csv")
    return found, mapped, metrics


def merge_sets(concepts: Sequence[DataFrame], concept: DataFrame, closure: DataFrame,
               expand: bool = True, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, final): union of standard concept sets, expanded; the final one without prefix.

    Without expansion only id and name exist, and the final set has just those.
    """
    merged = union_set([c.select("std_concept_id", "std_concept_name") for c in concepts])
    if expand:
        merged = expand_codeset(merged, concept, closure)
    columns = [c for c in ("std_concept_id", "std_concept_name", "std_concept_code",
                           "std_vocabulary_id") if c in merged.columns]
    final = rename_matching(merged.select(*columns).distinct(), "^std_", "")
    if path is not None:
        write_csv(final, path)
    return merged, final


def descendant_summary(merged: DataFrame) -> DataFrame:
    """Descendants per ancestor, largest first."""
    return (merged.groupBy("ancestor_concept_name").agg(F.count("*").alias("desc_ct"))
            .orderBy(F.desc("desc_ct"), "ancestor_concept_name"))


def merge_sets_from_files(spark: SparkSession, paths: Sequence[str], concept: DataFrame,
                          closure: DataFrame, path: str | None = None
                          ) -> tuple[DataFrame, DataFrame]:
    """Merge standard concept sets kept as CSV files."""
    sets = [read_csv(spark, p, STD_CONCEPTS) for p in paths]
    return merge_sets(sets, concept, closure, path=path)
