"""Softmax boosting over the binned matrix against plain Python and SQL."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import binning, boosting
from cohortloom.operators.boosting import ONE, Boost

SMALL_BOOST = Boost(rounds=4, depth=3, column_sample=0.7, keep_every=3)


@pytest.fixture(scope="module")
def study(spark):
    """Persons of three classes, flags and numbers that tell them apart, odd rows."""
    rng = np.random.default_rng(1)
    members, long = [], []
    for person in range(300):
        y = int(rng.integers(3))
        members.append((person, 1 + person % 3, int(y > 0), int(y > 1)))
        for k in range(12):
            if rng.random() < (0.6 if k % 3 == y else 0.2):
                long.append((person, "cond", f"flag_{k:02d}", 1.0, 1 + person % 3))
        for k in range(4):
            value = float(np.round(rng.normal(y - k, 2), 1)) if k < 2 else float(rng.integers(0, 900))
            long.append((person, "util", f"num_{k}", value, 1 + person % 3))
    long += [(5, "cond", "flag_01", None, 3), (6, "cond", "never", 0.0, 1), (7, "cond", "flag_02", float("nan"), 2),
             (9999, "cond", "flag_03", 1.0, 1), (8, "cond", "rare", 1.0, 3)]
    members.append((300, 1, 0, 0))  # nobody's features
    cohort = spark.createDataFrame(members, "person_id long, fold int, pasc_flag int, pasc_not_misc_flag int")
    return cohort, spark.createDataFrame(
        long, "person_id long, domain string, feature_key string, value double, fold int")


def plain(study):
    """(persons, folds, classes, {feature: {person: value}})."""
    cohort, long = study
    people = {r.person_id: (r.fold, r.pasc_flag + r.pasc_not_misc_flag) for r in cohort.collect()}
    values = defaultdict(dict)
    for r in long.collect():
        if r.value and not math.isnan(r.value):
            values[r.feature_key][r.person_id] = r.value
    return people, values


def slow_boost(people, values, slots, layout, model, boost):
    """The ensemble of one model by trying every cut of every drawn feature."""
    order = sorted(people)
    at = layout.models.index(model)
    margin = {p: [0.0] * 3 for p in order}
    train = [p for p in order if model == 0 or people[p][0] != model]
    out = []
    for tree in range(boost.rounds):
        probability = {}
        for p in order:
            e = np.exp(np.array(margin[p]) - max(margin[p]))
            probability[p] = e / e.sum()
        for c in range(3):
            drawn = layout.sampled(boost, tree, at, c)
            g = {p: round(float(np.rint((probability[p][c] - (people[p][1] == c)) * ONE))) for p in train}
            h = {p: round(float(np.rint(max(2 * probability[p][c] * (1 - probability[p][c]), 1 / ONE) * ONE)))
                 for p in train}

            def weight(rows):
                return -boost.learning_rate * (sum(g[p] for p in rows) / ONE) / (
                    sum(h[p] for p in rows) / ONE + boost.l2)

            def gain_of(gs, hs):
                return (gs / ONE) * (gs / ONE) / (hs / ONE + boost.l2)

            queue, nodes = [(1, train, order)], {}
            while queue:
                node, rows, everyone = queue.pop()
                gs, hs = sum(g[p] for p in rows), sum(h[p] for p in rows)
                best = None
                if node < 2 ** boost.depth and hs / ONE >= (2 * boost.min_child if node > 1 else 0):
                    for slot, key, cuts in slots:
                        for b, cut in enumerate(cuts[:-1]) if drawn[slot] else ():
                            left = [p for p in rows if values[key].get(p, 0.0) <= cut]
                            gl, hl = sum(g[p] for p in left), sum(h[p] for p in left)
                            if hl < ONE or hs - hl < ONE:
                                continue
                            gain = gain_of(gl, hl) + gain_of(gs - gl, hs - hl) - gain_of(gs, hs)
                            if gain > boost.min_gain and (best is None or gain > best[0]):
                                best = (gain, key, cut)
                if best is None:
                    nodes[node] = weight(rows)
                    for p in everyone:
                        margin[p][c] += nodes[node]
                    continue
                _, key, cut = best
                nodes[node] = (key, cut)
                for child, side in ((2 * node, True), (2 * node + 1, False)):
                    queue.append((child, *([p for p in some if (values[key].get(p, 0.0) <= cut) == side]
                                           for some in (rows, everyone))))
            out.append((tree, c, nodes))
    return out, margin


def layout_of(slots, models, present):
    sizes = [len(cuts) for _, _, cuts in slots]
    return boosting.Layout(np.concatenate([[0], np.cumsum(sizes)]), np.array([
        sum(c < 0 for c in cuts) for _, _, cuts in slots], np.uint8), present, models)


def test_trees_equal_trying_every_cut(spark, study):
    cohort, long = study
    fitted = boosting.cross_validate(cohort, long, folds=3, boost=SMALL_BOOST)
    slots = [(r.slot, r.feature_key, r.cuts) for r in fitted.slots.orderBy("slot").collect()]
    marks = {r.slot: r.present for r in binning.presence(long, fitted.slots, 3).collect()}
    present = np.array([marks[s] for s, _, _ in slots]).T
    layout = layout_of(slots, (1, 2, 3), present)
    people, values = plain(study)
    got = defaultdict(dict)
    for r in fitted.nodes.collect():
        got[r.model, r.tree, r.klass][r.node] = (r.feature_key, r.threshold) if r.feature_key else r.value
    scores = {r.person_id: r for r in fitted.predictions().collect()}
    for model in (1, 3):
        want, margin = slow_boost(people, values, slots, layout, model, SMALL_BOOST)
        for tree, c, nodes in want:
            mine = got[model, tree, c]
            assert set(mine) == set(nodes)
            for n, x in nodes.items():
                assert mine[n] == (x if isinstance(x, tuple) else pytest.approx(x, abs=1e-12))
        for p, (fold, y) in people.items():
            if fold == model:
                e = np.exp(np.array(margin[p]) - max(margin[p]))
                r = scores[p]
                assert r.y3 == y and [r.p0, r.p1, r.p2] == pytest.approx(list(e / e.sum()), abs=1e-12)


def node_rows(fitted):
    return sorted(map(tuple, fitted.nodes.collect()), key=lambda r: r[:4])


def test_partitions_do_not_change_the_ensemble(spark, study):
    """One job a round on one partition, one job a level on many: the same nodes."""
    cohort, long = study
    one = boosting.cross_validate(cohort, long, folds=3, boost=SMALL_BOOST)
    many = boosting.cross_validate(cohort.repartition(5), long.repartition(7), folds=3, boost=SMALL_BOOST, rows=40)
    assert many.matrix.rdd.getNumPartitions() > 1
    assert node_rows(one) == node_rows(many)
    assert sorted(map(tuple, one.predictions().collect())) == sorted(map(tuple, many.predictions().collect()))


def test_blocks_of_features_do_not_change_the_ensemble(spark, study, monkeypatch):
    cohort, long = study
    want = node_rows(boosting.train_full(cohort, long, SMALL_BOOST))
    monkeypatch.setattr(boosting, "BLOCK_BINS", 30)
    monkeypatch.setattr(boosting, "CELLS", 200)
    assert node_rows(boosting.train_full(cohort, long, SMALL_BOOST)) == want


def test_all_folds_read_one_matrix(spark, study, monkeypatch):
    calls, plain_rows = [], binning.binned_rows
    monkeypatch.setattr(binning, "binned_rows", lambda *a: calls.append(1) or plain_rows(*a))
    fitted = boosting.cross_validate(*study, folds=3, boost=Boost(rounds=1, depth=2))
    assert calls == [1] and {r.model for r in fitted.nodes.select("model").distinct().collect()} == {1, 2, 3}


def test_loss_falls_and_columns_are_drawn_once_a_tree(spark, study):
    boost = Boost(rounds=12, depth=4, column_sample=0.3)
    fitted = boosting.train_full(*study, boost=boost)
    loss = [r.loss for r in fitted.loss_table(spark).orderBy("round").collect()]
    assert len(loss) == 12 and loss[0] == pytest.approx(math.log(3))
    assert all(b < a for a, b in zip(loss, loss[1:]))
    n = fitted.slots.count()
    used = fitted.nodes.filter("feature_key is not null").groupBy("tree", "klass").agg(
        F.count_distinct("feature_key").alias("n"))
    assert used.agg(F.max("n")).first()[0] <= int(0.3 * n)
    off = fitted.predictions().filter(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-12)
    assert off.count() == 0


SCORES = """
WITH RECURSIVE walk AS (
  SELECT p.person_id, n.model, n.tree, n.klass, 1 AS node
  FROM people p, (SELECT DISTINCT model, tree, klass FROM nodes) n
  UNION ALL
  SELECT w.person_id, w.model, w.tree, w.klass,
         CASE WHEN coalesce(v.value, 0) > n.threshold THEN n."right" ELSE n."left" END
  FROM walk w JOIN nodes n USING (model, tree, klass, node)
  LEFT JOIN (SELECT * FROM long WHERE NOT isnan(value)) v
    ON v.person_id = w.person_id AND v.feature_key = n.feature_key
  WHERE n.feature_key IS NOT NULL)
SELECT w.person_id, w.model, w.klass, sum(n.value) AS margin
FROM walk w JOIN nodes n USING (model, tree, klass, node) WHERE n.feature_key IS NULL
GROUP BY ALL"""


def test_saved_nodes_give_the_scores_in_spark_and_sql(spark, study, tmp_path):
    cohort, long = study
    fitted = boosting.cross_validate(cohort, long, folds=3, boost=SMALL_BOOST)
    boosting.save(fitted, str(tmp_path / "model"))
    nodes = boosting.load(spark, str(tmp_path / "model"))
    got = {(r.model, r.person_id): (r.p0, r.p1, r.p2)
           for r in boosting.score(nodes, cohort, long).collect()}
    assert len(got) == 3 * cohort.count()
    for r in fitted.predictions().collect():
        assert got[r.fold, r.person_id] == pytest.approx((r.p0, r.p1, r.p2), abs=1e-12)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW nodes AS SELECT * FROM '{tmp_path}/model/*.parquet'")
    frames = {"people": cohort.select("person_id").toArrow(), "long": long.toArrow()}
    for name, frame in frames.items():
        con.register(name, frame)
    margins = defaultdict(lambda: [0.0] * 3)
    for person, model, klass, margin in con.execute(SCORES).fetchall():
        margins[model, person][klass] = margin
    for key, p in got.items():
        e = np.exp(np.array(margins[key]) - max(margins[key]))
        assert p == pytest.approx(tuple(e / e.sum()), abs=1e-12)


def test_bins(spark):
    rows = [(p, "many", float(p % 700)) for p in range(2000)] + [(p, "flag", 1.0) for p in range(0, 2000, 3)] + [
        (p, "signed", (-1.0) ** p * (p % 5)) for p in range(2000)] + [(1, "flag", None), (2, "none", float("nan"))]
    long = spark.createDataFrame(rows, "person_id long, feature_key string, value double")
    slots = {r.feature_key: r for r in binning.feature_slots(long).collect()}
    assert set(slots) == {"many", "flag", "signed"}
    assert sorted(r.slot for r in slots.values()) == [0, 1, 2]
    assert slots["flag"].cuts == [0.0, 1.0] and slots["flag"].zero == 0
    assert slots["signed"].zero == 4 and slots["signed"].cuts == [-4.0, -3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 4.0]
    cuts = slots["many"].cuts
    assert 200 < len(cuts) <= 256 and cuts[0] == 0.0 and cuts[-1] == 699.0
    sizes = Counter(np.searchsorted(cuts, [p % 700 for p in range(2000)]).tolist())
    assert max(sizes.values()) < 40
    members = spark.createDataFrame([(p, 1) for p in (0, 1, 3, 5000)], "person_id long, fold int")
    table = binning.feature_slots(long)
    got = {r.person_id: dict(zip(r.slots, r.bins)) for r in binning.binned_rows(members, long, table).collect()}
    s = {k: r.slot for k, r in slots.items()}
    assert got[5000] == {} and got[0] == {s["flag"]: 1}
    assert got[1] == {s["many"]: cuts.index(1.0) if 1.0 in cuts else int(np.searchsorted(cuts, 1.0)), s["signed"]: 3}
    assert set(got[3]) == set(s.values())


def test_slots_of_a_large_vocabulary(spark):
    """Slots come from a range sort; a million keys never pass the driver."""
    long = spark.range(1_000_000).select(F.lit(1).alias("person_id"), F.lpad("id", 9, "0").alias("feature_key"),
                                         F.lit(1.0).alias("value"))
    got = binning.feature_slots(long)
    assert got.filter(F.col("slot") != F.col("feature_key").cast("int")).count() == 0 and got.count() == 1_000_000


def test_nothing_to_learn_from(spark, study):
    cohort, long = study
    no_features = boosting.train_full(cohort, long.limit(0), SMALL_BOOST)
    assert no_features.nodes.filter("feature_key is not null").count() == 0
    shares = Counter(p[1] for p in plain(study)[0].values())
    first = no_features.predictions().first()
    assert max(shares, key=shares.get) == max(range(3), key=lambda k: first[f"p{k}"])
    nobody = boosting.cross_validate(cohort.limit(0), long, folds=3, boost=Boost(rounds=2, depth=2))
    assert nobody.predictions().count() == 0
    alone = boosting.cross_validate(cohort.filter("fold = 1"), long, folds=3, boost=Boost(rounds=2, depth=2))
    assert all(r[k] == pytest.approx(1 / 3) for r in alone.predictions().collect() for k in ("p0", "p1", "p2"))


def test_a_held_matrix_needs_no_job_a_round(spark, study, monkeypatch):
    """One task grows all rounds of a model; beyond what a task holds, levels are jobs: the same trees."""
    cohort, long = study
    with monkeypatch.context() as patch:
        patch.setattr(boosting, "_grow", None)
        held = boosting.cross_validate(cohort, long, folds=3, boost=SMALL_BOOST)
    monkeypatch.setattr(boosting, "HELD", 0)
    levels = boosting.cross_validate(cohort, long, folds=3, boost=SMALL_BOOST)
    assert node_rows(held) == node_rows(levels)
    assert [x[:2] for x in held.loss] == [x[:2] for x in levels.loss]
    assert [x[2] for x in held.loss] == pytest.approx([x[2] for x in levels.loss])
    assert sorted(map(tuple, held.predictions().collect())) == sorted(map(tuple, levels.predictions().collect()))


def test_scores_of_repeated_values(spark, study):
    """Each row counts: a leaf needs as many values that meet what zero does not as it has such conditions."""
    cohort, long = study
    fitted = boosting.train_full(cohort, long, SMALL_BOOST)
    again = long.union(long.filter("person_id % 7 = 0")).union(
        long.withColumn("value", F.lit(-5.0)).filter("person_id % 7 = 1 and domain = 'util' and value > 0"))
    nobody = long.limit(3).withColumn("person_id", F.lit(None).cast("long"))
    got = {r.person_id: (r.p0, r.p1, r.p2) for r in boosting.score(fitted.nodes, cohort, again.union(nobody)).collect()}
    rows = defaultdict(list)
    for r in again.collect():
        if r.value and not math.isnan(r.value):
            rows[r.person_id].append((r.feature_key, r.value))
    trees = defaultdict(dict)
    for r in fitted.nodes.collect():
        trees[r.tree, r.klass][r.node] = r
    for person in got:
        margin = [0.0] * 3
        for (_, c), tree in sorted(trees.items()):
            for node, leaf in tree.items():
                if leaf.feature_key is None:
                    tests = defaultdict(list)
                    while node > 1:
                        up = tree[node // 2]
                        tests[up.feature_key].append((up.threshold, node % 2))
                        node //= 2

                    def meets(key, v):
                        return all((v > cut) == bool(right) for cut, right in tests[key])

                    zero = {k: meets(k, 0.0) for k in tests}
                    seen = [(zero[k], meets(k, v)) for k, v in rows[person] if k in zero]
                    if seen.count((True, False)) == 0 and seen.count((False, True)) == list(zero.values()).count(False):
                        margin[c] += leaf.value
        e = np.exp(np.array(margin) - max(margin))
        assert got[person] == pytest.approx(tuple(e / e.sum()), abs=1e-12)
    assert len(got) == cohort.count()


def test_scores_do_not_join_values_with_leaves(spark, study):
    """A value meets its person's row only, however many trees ask for its feature."""
    cohort, long = study
    fitted = boosting.train_full(cohort, long, SMALL_BOOST)
    scored = boosting.score(fitted.nodes, cohort, long)
    assert "MapInArrow" in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.count() == cohort.count()
