"""Near-duplicate operators against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cohortloom.llm import bwt, common, embedding_dedup, hnsw, simhash, suffix_dedup
from cohortloom.llm.common import components, connect
from tests.conftest import SMALL
from tests.llm.conftest import prose


def groups_of(nodes, linked):
    """Smallest node reachable from each."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_components_join_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connect(df).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 450: 400, 500: 400}
    nodes = spark.createDataFrame([(3,), (9000,)], "n long")
    assert sorted(map(tuple, components(nodes, df).collect())) == [(3, 0), (9000, 9000)]


# SimHash -------------------------------------------------------------------------------
def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ")
             .replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_simhash(rows, names=False):
    prints = {(i, t): slow_fingerprint(t) for i, t in rows}
    fps = sorted(set(prints.values()))
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 3]
    group = groups_of(fps, near)
    low = {}
    for (i, _), f in prints.items():
        if i is not None:
            low[group[f]] = min(low.get(group[f], i), i)
    if names:
        return {i: group[f] for (i, _), f in prints.items()}, set(group.values())
    return sorted(((i, f"{f:016x}", low.get(group[f])) for (i, t) in rows
                   for f in [prints[i, t]]), key=repr)


@pytest.mark.parametrize("max_bucket", [simhash.MAX_BUCKET, 2])
def test_simhash_groups_equal_brute_force(odd_docs, max_bucket):
    got = simhash.simhash_groups(odd_docs, max_bucket=max_bucket).collect()
    got = sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got), key=repr)
    assert got == slow_simhash([(r.doc_id, r.text) for r in odd_docs.collect()])


def planted_prints():
    rng, out = random.Random(3), set()
    for _ in range(150):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(6)):       # chains of up to three flipped bits
            for _ in range(rng.randrange(1, 5)):
                at ^= 1 << rng.randrange(64)
            out.add(at)
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


@pytest.mark.parametrize("max_bucket", [simhash.MAX_BUCKET, 3])
def test_simhash_links_keep_every_group(spark, max_bucket):
    fps = planted_prints()
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:]
            if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    links = [tuple(r) for r in simhash.simhash_links(df, max_bucket=max_bucket).collect()]
    assert set(map(frozenset, links)) <= set(map(frozenset, near))
    assert groups_of(fps, links) == groups_of(fps, near)


def test_thresholds_obey_the_generalised_pigeonhole():
    rng = random.Random(1)
    for _ in range(50):
        costs = [{t: rng.random() * 10 ** t for t in range(4)} for _ in range(3)]
        got = simhash.allot(costs, 4)
        assert sum(t + 1 for t in got) == 4
        total = sum(c[t] for c, t in zip(costs, got) if t >= 0)
        every = [(a, b, 1 - a - b) for a in range(-1, 4) for b in range(-1, 4) if -1 <= 1 - a - b <= 3]
        assert total == pytest.approx(min(sum(c[t] for c, t in zip(costs, e) if t >= 0)
                                          for e in every))


def test_one_of_each_group_stays(odd_docs):
    kept = simhash.one_of_each_group(odd_docs.drop("fp")).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    _, groups = slow_simhash(rows, names=True)
    assert len(kept) == len(groups)       # id 8 has two texts, of different groups
    assert {r.doc_id for r in kept} == {c for _, _, c in slow_simhash(rows)}


# Repeated passages -----------------------------------------------------------------------
def slow_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if often[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found_repeats(df, **how):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)
                   for r in suffix_dedup.repeats(df, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"max_group": 1}, {"gram": 64, "cell": 16}])
def test_repeats_equal_brute_force(odd_docs, how):
    rows = [r for r in odd_docs.collect() if r.text is None or len(r.text) < 50_000]
    short = odd_docs.filter("text is null or length(text) < 50000")
    want = slow_repeats([r.text for r in rows], 400)
    assert found_repeats(short, **how) == sorted(
        ((r.doc_id, *w) for r, w in zip(rows, want)), key=repr)


@pytest.mark.parametrize("how", [{"max_group": 10_000}, {"max_group": 2}])
def test_repeats_of_short_strings(spark, how):
    rng = random.Random(5)
    stock = ["".join(rng.choice("abc ") for _ in range(40)) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = "".join(rng.choice(stock) if rng.random() < .5 else
                    "".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(8))
        at = rng.randrange(len(t))
        texts.append(t[:at] + rng.choice("xyzé") + t[at + 1:])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(((i, *w) for i, w in enumerate(slow_repeats(texts, 30))), key=repr)
    assert found_repeats(df, length=30, gram=12, cell=5, **how) == want


def test_very_long_texts_are_worked_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    rng = random.Random(8)
    one = "".join(rng.choice("abcdefghijklmnop") for _ in range(20_000))
    texts = [one, one[2500:9000] + "!" + one[12_000:12_500]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found_repeats(df) == [(i, *w) for i, w in enumerate(slow_repeats(texts, 400))]


def test_a_batch_of_texts_is_worked_in_small_parts():
    bodies = [prose(i, 150).encode() for i in range(3000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(bodies)), pa.int64()), pa.array([0] * len(bodies), pa.int32()),
         pa.array(bodies, pa.binary())], ["uid", "chk", "body"])
    tracemalloc.start()
    found = sum(b.num_rows for b in suffix_dedup._anchor_task(200, 64)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > len(bodies) and peak < 40 << 20
    packed = list(suffix_dedup._squeeze([batch]))
    assert len(packed) > 1
    packed = pa.Table.from_batches(packed).combine_chunks().to_batches()[0]
    spans = pa.array([[{"start": 1, "end": 3}]] * len(bodies), suffix_dedup._SPANS)
    both = pa.RecordBatch.from_arrays([*packed.columns, spans], ["uid", "chk", "body", "spans"])
    cut = list(suffix_dedup._cut_task(True, 0)([both]))
    assert len(cut) > 1
    cut = pa.Table.from_batches(cut)
    assert cut["uid"].to_pylist() == list(range(len(bodies)))
    assert cut["kept_text"].to_pylist() == [(b[:1] + b[3:]).decode() for b in bodies]


def test_slices_keep_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(common, "SLICE", 10)
    bodies = [b"", None, b"x" * 30, b"abc", b"defg", b"hij", None, b"", b"y" * 11, b""]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(bodies))), pa.array(bodies, pa.binary())], ["n", "body"])
    got = list(common.slices([batch, batch.slice(0, 0), batch.slice(3)]))
    assert [r for b in got for r in b["body"].to_pylist()] == bodies + bodies[3:]
    assert all(b.num_rows == 1 or sum(len(x or b"") for x in b["body"].to_pylist()) <= 10
               for b in got)


def test_periodic_texts_take_one_row_for_equal_runs(spark):
    texts = ["ab" * 100_000, "x" * 50_000, "one two three. " * 3000 + "ab" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").selectExpr(
        "uid", "cast(uid as int) as chk", "cast(text as binary) as body")
    found = suffix_dedup.anchors(df)
    rows, total = found.count(), found.selectExpr("sum(times * (hi - lo + 1))").first()[0]
    assert total == sum(len(t) - 399 for t in texts) and rows < 60
    got = suffix_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: (r.n_removed, len(r.spans)) for r in got.collect()} == {
        i: (len(t), 1) for i, t in enumerate(texts[:2])} | {2: (len(texts[2]), 1)}


def test_short_spans_stay(spark):
    long, short = prose(31, 60), prose(32, 45)
    df = spark.createDataFrame([(0, "a! " + long), (1, long + " z? " + short), (2, short + " b.")],
                               "doc_id long, text string")
    got = suffix_dedup.repeats(df, length=200, gram=64, min_words=51, keep_text=True)
    got = {r.doc_id: (r.kept_text, len(r.spans)) for r in got.collect()}
    assert got[0] == ("a! ", 1) and got[1] == (" z? " + short, 1) and got[2] == (short + " b.", 0)


def slow_passages(texts, length, words):
    """(number, bytes) of covered runs of enough words."""
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if often[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        edges = [i for i in range(len(b) + 1)
                 if (gone[i] if i < len(b) else 0) != (gone[i - 1] if i else 0)]
        found = [b[x:y] for x, y in zip(edges[::2], edges[1::2]) if len(b[x:y].split()) >= words]
        out.append((len(found), sum(map(len, found))))
    return out


@pytest.mark.parametrize("how", [{}, {"max_group": 1}])
def test_passages_beside_repeats_equal_brute_force(spark, odd_docs, how):
    rows = [r for r in odd_docs.collect() if r.text is None or len(r.text) < 50_000]
    short = odd_docs.filter("text is null or length(text) < 50000")
    texts = [r.text for r in rows]
    want = [(r.doc_id, *w, *p) for r, w, p in zip(
        rows, slow_repeats(texts, 400), slow_passages(texts, 200, 51))]
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, len(r.passages),
            sum(s.end - s.start for s in r.passages))
           for r in suffix_dedup.repeats_and_passages(short, **how).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query_tells_passages_shorter_than_its_strings(spark, tmp_path):
    words = "the old man saw the sea and had his tea by the fire".split()
    rng = random.Random(3)
    passage = " ".join(rng.choice(words) for _ in range(60))
    assert 200 <= len(passage) < 300
    rows = [(i, prose(40 + i, 70) + passage + prose(50 + i, 70), "en", "a", 0) for i in range(2)]
    rows += [(2, prose(60, 80), "en", "a", 0), (3, None, "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                          "n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed for i in range(4)] == [0, 0, 0, 0]
    assert [got[i].n_passages for i in range(4)] == [1, 1, 0, 0]
    assert got[0].passage_bytes == got[1].passage_bytes >= len(passage)


def test_spans_inside_shorter_spans_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    rng = random.Random(8)
    one = "".join(rng.choice("abcdefghijklmnop ") for _ in range(20_000))
    texts = [one, one[2500:9000] + "!" + one[12_000:12_300] + "?" + one[15_000:15_401] + "ab" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)
                 for r in suffix_dedup.repeats_and_passages(df).collect())
    assert got == [(i, *w) for i, w in enumerate(slow_repeats(texts, 400))]


def test_columns_that_only_passages_make_are_carried_along(spark):
    df = spark.createDataFrame([(0, "a", "w", "p")],
                               "doc_id long, text string, within string, passages string")
    row = suffix_dedup.repeats(df).first()
    assert (row.within, row.passages) == ("w", "p")
    row = suffix_dedup.repeats_and_passages(df).first()
    assert row.passages == [] and "within" not in row.asDict()


def test_kept_text_has_whole_characters(spark):
    shared = "é" * 300
    df = spark.createDataFrame([(0, "a" + shared + "ü"), (1, "bb" + shared + "ö")],
                               "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in suffix_dedup.repeats(df, keep_text=True).collect()}
    # The letters after the passage share their first byte with each other.
    assert got == {0: "a", 1: "bb"}


def test_interval_expansion_finds_repeated_strings():
    rng = np.random.default_rng(4)
    for n, sigma, least in ((300, 2, 9), (2000, 3, 6), (500, 26, 2), (1, 2, 1)):
        text = np.append(rng.integers(1, sigma + 1, n), 0)
        often = Counter(tuple(text[i:i + least]) for i in range(len(text) - least + 1))
        want = [i for i in range(len(text) - least + 1) if often[tuple(text[i:i + least])] > 1]
        assert bwt.repeated_starts(text, least).tolist() == want


# Embeddings ------------------------------------------------------------------------------
def vectors(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1, 1, 2):
        for _ in range(20):
            base = rng.normal(size=12)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((n, [float(x) for x in np.float32(base + rng.normal(size=12) * .08)], label))
                n += 1
    same = rows[3][1]
    rows += [(n + i, same, rows[3][2]) for i in range(30)] + [(3, same, rows[3][2])]
    rows += [(n + 40, None, 1), (n + 41, [0.0] * 12, 1), (n + 42, [float("nan")] * 12, 1),
             (n + 43, [None] + [1.0] * 11, 1), (n + 44, same, None), (n + 45, [], 1),
             (None, same, rows[3][2]), (n + 46, [1.0, 2.0], 1), (n + 47, [float("inf")] * 12, 1),
             (None, None, None)]
    return spark.createDataFrame([(*r, "x") for r in rows],
                                 "vec_id long, embedding array<float>, label int, n_links string")


def slow_vectors(rows):
    fine = [i for i, r in enumerate(rows) if r.label is not None and r.embedding and all(
        x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    unit = {i: np.array(rows[i].embedding) / np.linalg.norm(rows[i].embedding) for i in fine}
    linked = [(i, j) for i in fine for j in fine if i < j and rows[i].label == rows[j].label
              and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= .93]
    group = groups_of(range(len(rows)), linked)
    low = {}
    for i, r in enumerate(rows):
        if r.vec_id is not None:
            low[group[i]] = min(low.get(group[i], r.vec_id), r.vec_id)
    n = Counter(i for pair in linked for i in pair)
    return sorted(((r.vec_id, n[i], low.get(group[i]), r.vec_id == low.get(group[i]))
                   for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("shard", [embedding_dedup.SHARD, 40])
def test_embedding_groups_equal_brute_force(spark, shard):
    df = vectors(spark)
    got = embedding_dedup.embedding_groups(df, shard=shard)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_vectors(df.collect())


def test_audits_count_by_query():
    true = np.zeros((100, 2000), bool)
    true[0] = True                       # one query with very many links, and 99 with one each
    true[np.arange(1, 100), np.arange(1, 100)] = True
    found = true.copy()
    found[1:50] = False
    assert hnsw.recall(found, true) == pytest.approx(0.51) and hnsw.recall(true, true) == 1.0
    rng = np.random.default_rng(4)
    near = rng.normal(size=(30, 16)).repeat(20, axis=0) + rng.normal(size=(600, 16)) * .05
    near = (near / np.linalg.norm(near, axis=1, keepdims=True)).astype(np.float32)
    own, others = near[::2], near[1::2]
    graph = hnsw.build(own)
    width, reached = hnsw.audited_width(graph, .93)
    assert reached >= hnsw.WANTED
    # Even from a beam of one the audit leads to all links of another shard's vectors.
    for start in (1, width, 0):
        found = hnsw.audited_within(graph, others, .93, start)
        assert hnsw.recall(found, others @ own.T >= .93) >= hnsw.WANTED


def test_recall_of_the_index(spark):
    rows = spark.read.parquet(f"{SMALL}/../sf0.01/embeddings.parquet")
    got = embedding_dedup.embedding_groups(rows, shard=20)
    want = slow_vectors(rows.collect())
    found = sum(r.n_links for r in got.collect())
    assert found >= 0.9 * sum(w[1] for w in want)


def test_nothing_comes_of_nothing(spark, no_docs):
    assert simhash.simhash_groups(no_docs).count() == 0
    assert simhash.one_of_each_group(no_docs).count() == 0
    assert suffix_dedup.repeats(no_docs).count() == 0
    assert suffix_dedup.repeats_and_passages(no_docs).count() == 0
    assert embedding_dedup.embedding_groups(vectors(spark).limit(0)).count() == 0
