import pytest

from cohortloom.config import DOMAINS, CutThreshold
from cohortloom.operators import codesets, hierarchy as h
from cohortloom.sources.schemas import CDM_TABLES, SCAN, VOCABULARY_TABLES
from tests.conftest import day, rows

COND = DOMAINS["cond"]
# 1 -> 2 -> {4, 5}, 1 -> 3 -> {5, 6}; 9 is a lab child of 3.
PAIRS = [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (1, 2, 1), (1, 3, 1),
         (2, 4, 1), (2, 5, 1), (3, 5, 1), (3, 6, 1), (3, 9, 1), (1, 4, 2), (1, 5, 2), (1, 6, 2),
         (77, 5, 1)]


@pytest.fixture(scope="module")
def vocabulary(spark):
    concept = spark.createDataFrame(
        [(i, f"c{i}", f"code{i}", "SNOMED", "Condition", "x", None) for i in range(1, 7)]
        + [(9, "lab9", "l9", "LOINC", "Measurement", "x", None),
           (20, "icd", "S1", "ICD10CM", "Condition", "x", None),
           (21, "icd old", "S2", "ICD10CM", "Condition", "x", "D"),
           (22, "icd10", "S1", "ICD10", "Condition", "x", None)],
        VOCABULARY_TABLES["concept"])
    closure = spark.createDataFrame(PAIRS, VOCABULARY_TABLES["concept_ancestor"])
    relationship = spark.createDataFrame(
        [(20, 2, "Maps to", None), (20, 3, "Maps to", "D"), (22, 3, "Maps to", None),
         (20, 4, "Is a", None)], VOCABULARY_TABLES["concept_relationship"])
    return concept, closure, relationship


def edges(tree):
    return rows(tree, "ancestor_concept_id", "descendant_concept_id")


def test_tree_prune_roots_and_export(spark, vocabulary):
    concept, closure, _ = vocabulary
    tree = h.make_tree(concept, closure, COND)
    assert edges(tree) == [(1, 2), (1, 3), (2, 4), (2, 5), (3, 5), (3, 6), (3, 9)]
    assert edges(h.make_tree(concept, closure, COND, prune_root=2)) == [(1, 3), (3, 6), (3, 9)]
    assert rows(h.tree_roots(tree), "descendant_concept_id") == [(1,)]
    assert ("c1, 1", 1) in rows(h.tree_nodes(tree), "node_concept", "node_concept_id")
    exported = h.tree_export(tree, [(441840, "top")])
    assert exported.count() == 8
    assert rows(exported.filter("ancestor_concept_id IS NULL"),
                "descendant_concept_id", "descendant_concept_name") == [(441840, "top")]


def test_node_counts_windows_and_folds(spark, vocabulary):
    concept, closure, _ = vocabulary
    tree = h.make_tree(concept, closure, COND)
    index = day("2021-08-31")
    cohort = spark.createDataFrame(
        [(1, index, 1, 1), (2, index, 0, 2), (3, index, 0, 1), (4, day("2022-03-01"), 1, 1)],
        "person_id long, index_date date, pasc_flag int, fold int")
    dates = {1: "2021-08-03", 2: "2021-08-02", 3: "2022-02-27", 4: "2022-02-28"}
    visits = spark.createDataFrame([(v, 0, 0, day(d)) for v, d in dates.items()],
                                   CDM_TABLES["visit_occurrence"])
    events = spark.createDataFrame([
        (1, 1, 1, 4, 4, ""), (2, 1, 1, 4, 4, ""),   # person 1 twice on node 4
        (3, 2, 2, 4, 4, ""),                       # day -29
        (4, 2, 3, 4, 4, ""), (5, 3, 3, 6, 6, ""),    # last day before index + 6 months
        (6, 3, 4, 4, 4, ""),                       # index + 6 months (clamped) is out
        (7, 4, 3, 4, 4, ""),                       # index too late for follow-up
        (8, 1, 1, 50, 50, ""),                     # unknown node
    ], CDM_TABLES["condition_occurrence"])
    args = (cohort, events, visits, COND, -28, 6, day("2022-09-01"))
    got = rows(h.node_counts(tree, *args), "node", "pop_count", "case_count", "control_count")
    assert got == [(4, 2, 1, 1), (6, 1, 0, 1)]
    folds = rows(h.node_counts_by_fold(tree, *args, folds=2), "split", "node", "pop_count",
                 "case_count", "control_count")
    assert folds == [("1", 4, 1, 0, 1), ("2", 4, 1, 1, 0), ("2", 6, 1, 0, 1),
                     ("all", 4, 2, 1, 1), ("all", 6, 1, 0, 1)]


def scan(spark, data):
    return spark.createDataFrame(
        [(i, node, level, 1.0, llr, n, 1.0, p) for i, (node, level, llr, n, p)
         in enumerate(data)], SCAN)


def test_cuts_expansion_deduplication_and_features(spark, vocabulary):
    concept, closure, _ = vocabulary
    nodes = h.tree_nodes(h.make_tree(concept, closure, COND))
    cuts = h.select_cuts(scan(spark, [
        (2, 4, 5.0, 2000, 0.001), (3, 4, 9.0, 2000, 0.001), (4, 3, 9.5, 2000, 0.001),
        (5, 4, 8.0, 1600, 0.001), (6, 4, 7.0, 2000, None), (77, 4, 6.0, 2000, 0.001)]),
        nodes, CutThreshold(3, 1600, level_op=">", observations_op=">"))
    assert rows(cuts, "cut_rank", "node_identifier", "node_concept") == [
        (1, 3, "c3, 3"), (2, 77, None), (3, 2, "c2, 2")]
    pairs = h.expand_cuts(cuts, concept, closure, COND)
    assert edges(pairs) == [(2, 2), (2, 4), (2, 5), (3, 3), (3, 5), (3, 6), (3, 9)]
    first = h.expand_cuts(cuts, concept, closure, COND, deduplicate=True)
    assert edges(first) == [(2, 2), (2, 4), (3, 3), (3, 5), (3, 6), (3, 9)]
    known = nodes.filter("node_concept_id <> 6")
    got = h.make_features(cuts, known, concept, closure, COND)
    assert edges(got) == [(2, 2), (2, 4), (2, 5), (3, 3), (3, 5), (3, 9)]


def test_cut_overlap(spark):
    cuts = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (3, 2)],
                                 "node_identifier long, fold int")
    assert rows(h.cut_overlap(cuts), "folds", "nodes") == [("1", 1), ("1,2", 2)]


def test_codeset_lookup_mapping_and_expansion(spark, vocabulary):
    concept, closure, relationship = vocabulary
    codes = spark.createDataFrame([("S1", "first (ICD10CM)"), ("S2", "second (ICD10CM) "),
                                   ("S3", "third")], "code string, description string")
    vocabularies = codesets.infer_vocabularies(codes)
    assert rows(vocabularies) == [("ICD10",), ("ICD10CM",)]
    found, mapped, metrics = codesets.process_codes(codes, concept, relationship, vocabularies)
    assert rows(found, "concept_id") == [(20,), (22,)]
    assert rows(mapped, "source_concept_id", "std_concept_id", "orig_code") == [
        (20, 2, "S1"), (22, 3, "S1")]
    assert dict(rows(metrics)) == {"Source codes": 3, "Source concepts": 2,
                                   "Mapped concepts": 2, "Standard concepts": 2}
    merged, final = codesets.merge_sets([mapped, mapped], concept, closure)
    assert rows(final, "concept_id") == [(i,) for i in (2, 3, 4, 5, 6, 9)]
    assert rows(codesets.descendant_summary(merged)) == [("c2", 3), ("c3", 4)]
    plain = codesets.merge_sets([mapped], concept, closure, expand=False)[1]
    assert plain.columns == ["concept_id", "concept_name"]
    ids = spark.createDataFrame([(20,), (21,)], "concept_id long")
    assert rows(codesets.find_concepts_from_cids(ids, concept), "concept_id") == [(20,), (21,)]
    assert rows(codesets.find_concepts_from_cids(ids, concept, True), "description") == [
        ("icd",)]
    codeset = spark.createDataFrame([(2,), (3,)], "concept_id long")
    assert rows(codesets.get_descendants(codeset, concept, closure), "concept_id") == [
        (i,) for i in (2, 3, 4, 5, 6, 9)]
