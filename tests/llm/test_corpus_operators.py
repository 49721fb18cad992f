"""Classifiers, mixing, sharding, and the pipeline."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import mixing, quality_model, registry, sharding, toxicity
from cohortloom.llm.common import held_out
from tests.conftest import SMALL

MEDIUM = "/root/testdata/sf0.1"


def n_words(text):
    return len((text or "").encode().split())


# Classifiers -----------------------------------------------------------------------------
@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.95),
                                                ("op5_quality_model", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = registry.QUERIES[name](spark, MEDIUM).join(labels, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least


def test_held_out_rows_are_those_of_the_checksum(spark):
    ids = spark.range(500).withColumnRenamed("id", "doc_id")
    got = {r[0]: r[1] for r in ids.select("doc_id", held_out("doc_id")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(500)}


def labels_of(spark, value):
    return spark.createDataFrame([(i, value, value) for i in range(30)] + [(None, 1, 0), (5, None, None)],
                                 "doc_id long, toxic int, quality int")


def test_classifiers_score_odd_documents(spark, odd_docs):
    mixed = spark.createDataFrame([(i, i % 2, i % 2) for i in range(18)] + [(None, 1, 1), (3, None, None), (4, 1, 1)],
                                  "doc_id long, toxic int, quality int")
    n = odd_docs.count()
    for labels in (mixed, labels_of(spark, 1), labels_of(spark, 0), labels_of(spark, 1).limit(0)):
        tox = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels)).collect()
        stats = quality_model.document_statistics(odd_docs)
        good = quality_model.score(stats, quality_model.fit(stats, labels)).collect()
        assert len(tox) == len(good) == n
        assert all(0 <= r.score <= 1 for r in tox + good)


def test_classifiers_never_see_held_out_labels(spark, odd_docs):
    ids = [i for i in range(18) if zlib.crc32(str(i).encode()) % 5 == 0]
    base = [(i, i % 2, i % 2) for i in range(18)]
    turned = [(i, 1 - t if i in ids else t, 1 - q if i in ids else q) for i, t, q in base]
    schema = "doc_id long, toxic int, quality int"
    a, b = (toxicity.fit(odd_docs, spark.createDataFrame(x, schema)) for x in (base, turned))
    assert (a.weights == b.weights).all() and a.bias == b.bias


# Mixing ----------------------------------------------------------------------------------
def slow_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_totals(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet").unionByName(
        spark.createDataFrame([(9000 + i, "w " * (i + 1), None, None if i % 2 else "tiny", 1)
                               for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long"))
    sized = mixing.sizes(docs)
    rows = mixing.per_row(mixing.mix(sized)).collect()
    again = mixing.per_row(mixing.mix(sized.repartition(7))).collect()
    key = ["doc_id", "source", "size", "copies"]
    assert sorted(([r[k] for k in key] for r in rows), key=repr) == sorted(
        ([r[k] for k in key] for r in again), key=repr)
    size, taken, most, target = (defaultdict(int) for _ in range(4))
    for r in rows:
        assert r.copies <= 3
        size[r.source] += r.size
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
        target[r.source] = r.target
    want = slow_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    assert len(rows) == docs.count()


def test_rounding_has_no_bias(spark):
    docs = spark.createDataFrame([(i, "a", 10 + i % 7) for i in range(40)]
                                 + [(100 + i, "b", 12) for i in range(40)],
                                 "doc_id long, source string, size long")
    n = defaultdict(int)
    for seed in range(12):
        for r in mixing.per_row(mixing.mix(docs, seed=seed)).collect():
            n[r.source] += r.copies
    share = {s: v / (12 * 40) for s, v in n.items()}
    assert share["a"] == pytest.approx(10 / 7, abs=0.1)
    assert share["b"] == pytest.approx(4 / 7, abs=0.1)


def test_mixing_odd_documents(odd_docs, no_docs):
    rows = mixing.per_row(mixing.mix(mixing.sizes(odd_docs))).collect()
    assert sorted((r.size for r in rows)) == sorted(n_words(r.text) for r in odd_docs.collect())
    units = mixing.mix(mixing.sizes(odd_docs))
    repeated = mixing.repeat_rows(odd_docs, units)
    assert repeated.columns == odd_docs.columns
    assert repeated.count() == sum(r.copies for r in rows)
    clashing = odd_docs.withColumns({c: F.lit(7) for c in ("m", "copies", "size", "bucket", "p")})
    assert mixing.repeat_rows(clashing, units).count() == repeated.count()
    assert mixing.repeat_rows(clashing, units).columns == clashing.columns
    assert mixing.per_row(mixing.mix(mixing.sizes(no_docs))).count() == 0


def test_a_hot_unit_shares_its_copies(spark):
    docs = spark.createDataFrame([(1, "a", 4)] * 900 + [(i, "b", 9) for i in range(60)],
                                 "doc_id long, source string, size long")
    rows = [r.copies for r in mixing.per_row(mixing.mix(docs)).collect() if r.source == "a"]
    assert len(rows) == 900 and max(rows) - min(rows) <= 1


# Sharding --------------------------------------------------------------------------------
def test_shards(spark, odd_docs, tmp_path):
    rows = sharding.records(odd_docs)
    sums = sharding.slot_sums(rows)
    table = sharding.store_map(spark, str(tmp_path / "map"), 0, sharding.first_map(sums), sums)
    got = sharding.place(rows, table).collect()
    assert len(got) == odd_docs.count()
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    want = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
                  for r in odd_docs.collect())
    assert sorted((r.size, r.text_crc32) for r in got) == want


def test_shards_are_even_and_reruns_agree(spark):
    folder = f"{SMALL}/../sf0.01"
    got = sorted(map(tuple, sharding.op8_sharding(spark, folder).collect()))
    assert got == sorted(map(tuple, sharding.op8_sharding(spark, folder).collect()))
    load = defaultdict(int)
    for r in got:
        load[r[4]] += r[1]
    assert len(load) == 16 and max(load.values()) <= 1.02 * min(load.values())


@pytest.mark.parametrize("hot", [(7, None), (None, "one text"), (7, "one text")])
def test_a_hot_key_fills_no_shard(spark, tmp_path, hot):
    """A third of all rows share an id, a text without an id, or both."""
    n = 60_000
    docs = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(hot[0])).otherwise(F.col("id") + 100).cast("long").alias("doc_id"),
        F.when((F.col("id") % 3 == 0) & F.lit(hot[1] is not None), F.lit(hot[1]))
        .otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    rows = sharding.records(docs)
    sums = sharding.slot_sums(rows)
    assert max(count for _, count in sums.values()) <= 60
    table = sharding.store_map(spark, str(tmp_path / "map"), 0, sharding.first_map(sums), sums)
    got = sharding.place(rows, table)
    by_shard = got.groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"),
                                        F.min("slot").alias("low"), F.max("slot").alias("high"),
                                        F.count_distinct("slot").alias("slots")).collect()
    assert len(by_shard) == 16 and sum(r.n for r in by_shard) == n
    assert all(r.low == 0 and r.high == r.n - 1 and r.slots == r.n for r in by_shard)
    assert max(r.size for r in by_shard) <= 1.02 * min(r.size for r in by_shard)
    other = sharding.records(docs.repartition(11))
    assert other.exceptAll(rows).count() == rows.exceptAll(other).count() == 0


def test_rebalancing_edits_a_stored_map(spark, tmp_path):
    sums = {v: (1000 + v % 13, 1) for v in range(sharding.SLOTS)}
    old = sharding.first_map(sums)
    new = sharding.rebalanced(old, sums, 17)
    moved = [v for v in old if old[v] != new[v]]
    assert {new[v] for v in moved} == {16}
    assert len(moved) <= sharding.SLOTS / 17 * 1.05
    fewer = sharding.rebalanced(new, sums, 12)
    assert set(fewer.values()) == set(range(12))
    path = str(tmp_path / "map")
    sharding.store_map(spark, path, 0, old, sums)
    sharding.store_map(spark, path, 1, new, sums)
    assert {r.vslot: r.shard for r in sharding.read_map(spark, path).collect()} == new
    assert {r.vslot: r.shard for r in sharding.read_map(spark, path, 0).collect()} == old


def test_shards_of_nothing(spark, no_docs, tmp_path):
    rows = sharding.records(no_docs)
    table = sharding.store_map(spark, str(tmp_path / "m"), 0, sharding.first_map({}), {})
    assert sharding.place(rows, table).count() == 0
