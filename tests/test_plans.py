"""The four jobs end to end over the smallest driver tables."""

from dataclasses import replace

from pyspark.sql import functions as F

from cohortloom.config import DOMAINS
from cohortloom.operators import train, wide
from cohortloom.plans import study as plans
from cohortloom.sources import files
from cohortloom.sources.catalog import TableCatalog
from cohortloom.sources.schemas import SCAN, SCAN_HEADER
from cohortloom.sources.star_mapping import STAR_CONFIG, StarTables
from tests.conftest import SMALL


def test_study_from_tables_to_model(spark, tmp_path):
    cfg = replace(STAR_CONFIG, folds=2, trees=2, tree_depth=2)
    star = StarTables(spark, SMALL, cfg)
    catalog = TableCatalog(spark, str(tmp_path / "cdm"), str(tmp_path / "vocab"),
                           str(tmp_path / "results"))
    for name, df in {
            "observation_derivation": star.observations, "condition_occurrence": star.conditions,
            "visit_occurrence": star.visits, "adt_occurrence": star.adt, "person": star.person,
            "measurement_labs": star.labs, "procedure_occurrence": star.procedures,
            "drug_exposure": star.drugs}.items():
        df.write.parquet(f"{catalog.cdm}/{name}")
    for name in ("concept", "concept_ancestor"):
        getattr(star, name).write.parquet(f"{catalog.vocabulary}/{name}")
    rules = str(tmp_path / "rules")
    files.write_csv(star.rules, rules)

    cohort = plans.build_cohort(catalog, cfg, rules)
    persons = cohort.count()
    assert persons == cohort.select("person_id").distinct().count() > 50
    steps = [r.persons for r in catalog.results_tbl("attrition").orderBy("step_number").collect()]
    assert steps == sorted(steps, reverse=True) and steps[-1] == persons

    inputs = plans.build_tree_inputs(catalog, cfg)
    assert {r.split for r in inputs["counts"].select("split").distinct().collect()} == {
        "all", "1", "2"}

    paths = {}
    for domain in DOMAINS:
        scan = star.scan(cohort, domain).select(*[f.name for f in SCAN.fields])
        path = str(tmp_path / f"scan_{domain}")
        files.write_csv(scan.toDF(*SCAN_HEADER), path)
        paths[domain] = {"all": path, "1": path, "2": path}
    cuts = plans.read_cuts(catalog, cfg, paths)
    built = plans.build_features(catalog, cfg, cuts)
    long = built["long"]
    assert {r.domain for r in long.select("domain").distinct().collect()} == {
        "demo", "util", "lab_cts", *DOMAINS}
    assert long.groupBy("person_id", "domain", "feature_key").count().filter(
        "count > 1").count() == 0
    assert built["dictionary"].filter(F.col("label").isNull()).count() == 0

    slots = plans.build_wide(catalog, "1", str(tmp_path / "wide"))
    assert slots.count() == plans.split_rows(catalog, "1").select("feature_key").distinct().count()
    columns = wide.column_group(spark, str(tmp_path / "wide"), slots, 0)
    assert columns.count() == persons and "entry_age" in columns.columns

    out = plans.train_model(catalog, cfg, str(tmp_path / "model"), train.random_forest(cfg))
    scored = out["predictions"]
    assert scored.count() == persons
    off = scored.filter(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9)
    assert off.count() == 0
    assert out["metrics"].count() == 2 * 3 * 2
    assert out["columns"].count() > 20

    boosted = plans.train_model(catalog, replace(cfg, trees=3, tree_depth=3), str(tmp_path / "nodes"))
    assert boosted["predictions"].count() == persons
    assert boosted["nodes"].select("tree", "klass").distinct().count() == 9
    assert boosted["loss"].count() == 3 * cfg.folds
    assert boosted["columns"].count() > 20
