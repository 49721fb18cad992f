"""Collocations, packing and lexical search against brute force."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortloom.llm import bpe, collocations, lexical_search, packing
from tests.conftest import SMALL
from tests.llm.conftest import TEXTS, prose

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Collocations --------------------------------------------------------------------------
def slow_collocations(rows, min_count, percent, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    counts[lang][tuple(w[i:i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}

        def inside(p, q):
            return len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))

        ranked = []
        for p, a in found.items():
            if any(inside(p, q) and 100 * c >= percent * a for q, c in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


PHRASES = [("en", "New York is big. new york, New York!\nin new york city hall\tnew york"),
           ("en", "the cat the cat the cat sat on the mat; the cat sat"), ("fr", "le chat, le chat"),
           (None, "a b a b a b"), (None, None), ("en", ""), ("en", " \t \n . ; "),
           ("fr", "Éa éa ÉA éa b\x0bc d"), ("en", "x " * 50), ("de", "nichts")]


@pytest.mark.parametrize("percent", [100, 60])
@pytest.mark.parametrize("shape", [{}, {"block_words": 7, "word_lanes": 3, "lane_bits": 0, "max_bits": 10}])
def test_collocations_equal_brute_force(spark, percent, shape):
    rows = PHRASES * 3 + [("en", prose(s, 200)) for s in (1, 1, 1, 2)] + [
        ("en", TEXTS[11]), ("en", "ab" * 3000), ("fr", prose(5, 3000))]
    docs = spark.createDataFrame(
        [(r[0], r[1], "x", 1, 2.0) for r in rows], "lang string, text string, phrase string, f int, n double"
    ).repartition(3)
    got = collocations.collocations(docs, 3, percent, 50, **shape)
    assert sorted(map(tuple, got.collect())) == slow_collocations(rows, 3, percent, 50)


@pytest.mark.parametrize("length", [1, 3])
def test_collocations_count_a_block_in_little_memory(length):
    rng = random.Random(5)
    block = collocations._Block()
    for _ in range(60):
        block.add("en", [b"w%d" % int(3000 * rng.random() ** 3) for _ in range(10_000)])
    table = collocations.PhraseTable(np.full(1024, 5, np.uint8))
    tracemalloc.start()
    try:
        n = sum(len(x[4]) for x in collocations._stripes_of(block, length, table, 1024, 16))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 4 * 100_000
    assert peak < 60 * block.size


def test_collocations_span_slices_of_long_texts(spark, monkeypatch):
    text = "one two three four, " * 40 + "five" * 30 + " one two " + "\t" * 90 + "three"
    assert [w for part in collocations.tokens(text.encode()) for w in part]
    whole = [w for part in collocations.tokens(text.encode()) for w in part]
    monkeypatch.setattr(collocations, "SLICE", 16)
    assert [w for part in collocations.tokens(text.encode()) for w in part] == whole


def test_collocation_scores_are_exact(spark):
    f = [("en", "a", 10**14), ("en", "b", 3 * 10**13), ("en", "a b", 10**13)]
    got = collocations.scored(spark.createDataFrame(f, "lang string, phrase string, f long"),
                              spark.createDataFrame([("en", 10**17 + 7)], "lang string, n long")).first()
    assert got.score == 1000 * 10**13 * (10**17 + 7) // (10**14 * 3 * 10**13)


def test_collocations_of_odd_and_no_documents(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    got = collocations.collocations(odd_docs, 5)
    assert sorted(map(tuple, got.collect())) == slow_collocations(rows, 5, 100, 2000)
    assert collocations.collocations(no_docs).count() == 0


# Packing -------------------------------------------------------------------------------
def check_packing(docs, pieces, length, per_task=None):
    """Every id in one piece, windows gapless and never padded; returns windows."""
    vocabulary = open(bpe.vocabulary_path("byte_bpe_50k.json"), encoding="utf-8").read()
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(vocabulary)
    want = Counter((d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]))
                   for d, t in docs)
    by_doc, windows = defaultdict(dict), defaultdict(dict)
    for p in pieces:
        assert len(p.ids) == p.length
        windows[p.sequence_id][p.offset] = p.length
        # Rows that repeat an id are told apart by their tokens.
        by_doc[p.doc_id, p.doc_tokens].setdefault(p.start, []).append(p.ids)
    for parts in windows.values():
        at = 0
        for offset in sorted(parts):
            assert offset == at and parts[offset] > 0
            at += parts[offset]
        assert at <= length and (at == length or at & (at - 1) == 0)
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    for (doc, ids), n in want.items():
        if sum(1 for d, i in want if d == doc and len(i) == len(ids)) == n == 1:
            at = 0
            parts = by_doc[doc, len(ids)]
            for start in sorted(parts):
                assert start == at
                for part in parts[start]:
                    assert tuple(part) == ids[at:at + len(part)]
                at += len(parts[start][0])
            assert at == len(ids)
    return windows


@pytest.mark.parametrize("length, max_open", [(2048, 2048), (64, 3), (100, 1)])
def test_pieces_make_up_the_documents(spark, odd_docs, length, max_open):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = packing.pack(odd_docs, length=length, max_open=max_open).collect()
    check_packing(docs, got, length)
    digest = packing.pack(odd_docs, length=length, max_open=max_open, digest=True).collect()
    assert sorted(zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in got) == sorted(
        p.ids_crc32 for p in digest)


def test_packing_special_tokens_as_the_library(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "  \n\n x\t", "'ll I'LL    ٣٤ ½", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(list(enumerate(texts)), packing.pack(docs).collect(), 2048)


def test_packing_small_tables(spark, no_docs):
    assert packing.pack(no_docs).count() == 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = packing.pack(docs).collect()
    windows = check_packing([(r.doc_id, r.text) for r in docs.collect()], got, 2048)
    full = sum(sum(w.values()) == 2048 for w in windows.values())
    assert full > 0.8 * len(windows)


def slow_choice(levels, n, length):
    """The level that leaves the smallest sum of squares, the fullest of equals, 0 last."""
    def squares(counts):
        return sum(c * c for h, c in counts.items() if h < length and h & (h - 1))

    options = []
    for h in [h for h, c in levels.items() if c and h + n <= length] + [0]:
        after = Counter(levels)
        if h:
            after[h] -= 1
        after[h + n] += 1
        options.append((squares(after), -h, h))
    return min(options)[2]


def test_items_go_where_squares_are_least():
    rng = np.random.default_rng(5)
    packer = packing.Packer(50, 10**6)
    for doc in range(400):
        n = int(rng.choice([3, 7, 11, 19, 30, 33, 47]))
        levels = Counter({h: int(c) for h, c in enumerate(packer.count) if c})
        assert packer._choose(n) == slow_choice(levels, n, 50)
        packer.add(doc, np.arange(n, dtype=np.uint32))
    assert packer.n_open == packer.count.sum() == sum(map(len, packer.windows))


def test_open_windows_are_bounded():
    packer = packing.Packer(100, 4)
    for doc in range(300):
        packer.add(doc, np.arange(60 + doc % 7, dtype=np.uint32))
        assert packer.n_open <= 4
    packer.finish()
    fill = Counter()
    for _, _, ids, _, window, _ in packer.done:
        fill[window] += len(ids)
    assert sum(fill.values()) == sum(60 + d % 7 for d in range(300))
    assert all(n == 100 or n & (n - 1) == 0 for n in fill.values())


# Lexical search ------------------------------------------------------------------------
def slow_search(docs, items, k=10):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))

    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = defaultdict(Counter)
    for item, text in set(items):
        asked[item] += Counter(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc, bag, n in bags:
            m = 25 + (75 * n * n_docs) // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, c in wanted.items() if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s)
                for rank, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(0, "river1 stone light0"), (1, "River1, RIVER1 garden-winter3"), (2, None), (3, ""),
         (4, "nowhere"), (5, "spam ham"), (None, "stone3"), (6, "é straße ñandú"), (7, "one two"),
         (7, "one two"), (7, "table5"), (8, prose(7, 60)), (9, "abab " * 40 + "x")]


@pytest.mark.parametrize("shape", [{}, {"block_docs": 3, "block_queries": 4, "lane_rows": 1}])
@pytest.mark.parametrize("k", [10, 2])
def test_search_equals_brute_force(spark, odd_docs, shape, k):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = spark.createDataFrame([(i, t, 0, "y", 1) for i, t in ITEMS],
                                  "item_id long, text string, score int, term string, shard int")
    got = lexical_search.search(odd_docs, items, k, **shape)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_search(docs, ITEMS, k)


def test_search_stops_early_and_keeps_ties():
    """Lists are read in steps; the result is that of reading all of them."""
    rng = np.random.default_rng(3)
    for k in (1, 10):
        for n in (5, 3000):
            lists = []
            for _ in range(6):
                docs = rng.permutation(n)[:rng.integers(1, n + 1)]
                gains = np.sort(rng.integers(1, 50, len(docs)))[::-1].astype(np.int64)
                lists.append((docs, gains))
            score = np.zeros(n, np.int64)
            for docs, gains in lists:
                score[docs] += gains
            least = max(1, np.sort(score)[::-1][:k][-1])
            found, exact = lexical_search.nra(lists, n, 0, k)
            assert {*np.flatnonzero(score >= least)} <= set(found.tolist())
            assert (score[found] == exact).all()
            assert not len(lexical_search.nra(lists, n, 301, k)[0])


def test_search_on_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(no_docs, items).count() == 0
    assert lexical_search.search(odd_docs, items.filter("false")).count() == 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    asked = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = lexical_search.op13_lexical_search(spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_search(
        [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in asked.collect()])
