"""Operators on one document at a time: rules, licenses, BPE."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortloom.llm import bpe, licenses, quality_rules
from tests.compare import difference
from tests.conftest import SMALL
from tests.llm.conftest import prose
from tests.run_oracle import connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("module", [quality_rules, licenses])
def test_query_matches_sql(spark, module):
    (name, query), = module.QUERIES.items()
    assert difference(query(spark, SMALL), connect(SMALL).execute(module.ORACLE[name])) is None


def test_rules_on_odd_texts(odd_docs):
    for r in quality_rules.quality_rules(odd_docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base_counts(r.text)
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
        assert r.clean_text is not None
        if r.text and r.text.startswith("Home |"):
            assert r.kept and r.clean_text == r.text.split("\n", 1)[1]


def test_rules_reject_what_is_mostly_menu(spark):
    menu = "\n".join(f"Home{i} | News{i} | More{i} | Help{i}" for i in range(6))
    shout = " ".join(f"BUY{i}!!" for i in range(40))
    clean = prose(3, 120)
    docs = spark.createDataFrame([(0, menu), (1, shout), (2, clean)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert kept == {0: False, 1: False, 2: True}


def test_rules_count_words_not_blanks(spark):
    """Indented, padded, tabbed and CRLF lines are judged by their words."""
    around = [lambda x: x, lambda x: " " * 26 + x, lambda x: x + "\t" * 30, lambda x: x + " \r"]
    between = [lambda x: "\t" + x.replace(" ", "   "), lambda x: x.replace(" ", " \t\x0b\x0c ") + "\r"]
    furniture = ["Privacy Policy", "twelve words of furniture that say read more in one short line"]
    plain = [("Home » About us » Contact our team", True), ("four words without marks", False),
             ("a title of words " * 8 + "that never ends", True), (prose(5, 12), False)]
    lines = [(f(x), True) for x in furniture for f in around]
    lines += [(f(x), failed) for x, failed in plain for f in around + between]
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, (line, failed) in enumerate(lines):
        assert got[i].lost_share == (1.0 if failed else 0.0), line
        assert got[i].clean_text == ("" if failed else line)


def test_licenses_on_odd_texts(odd_docs):
    got = [(r.doc_id, r.license, r.containment) for r in licenses.license_matches(odd_docs).collect()]
    assert got == [(16, "mit", 1.0)]


def test_licenses_need_most_of_a_template(spark):
    body = dict(licenses.TEMPLATES)["mit-text"]
    half, near = body[:len(body) // 2], body.replace("without restriction", "without limits")
    docs = spark.createDataFrame([(0, f"Some words first. {near} And more."), (1, half), (2, body),
                                  (2, body)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license) for r in licenses.license_matches(docs).collect())
    assert got == [(0, "mit-text"), (2, "mit-text"), (2, "mit-text")]
    with pytest.raises(ValueError):
        licenses.license_matches(docs, [("short", "two words")])


def test_licenses_with_inserted_words_at_every_offset(spark):
    body = dict(licenses.TEMPLATES)["mit-text"].split()
    notice = " ".join(body[:14] + ["inserted"] * 10 + body[14:])
    docs = spark.createDataFrame([(i, "before " * i + notice + " after" * 70) for i in range(60)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_matches(docs).collect() if r.license == "mit-text"}
    assert sorted(got) == list(range(60))
    assert all(r.start_word == i and 0.8 <= r.containment < 1 for i, r in got.items())


def test_license_spans_against_plain_python(spark):
    rng, words = random.Random(5), dict(licenses.TEMPLATES)["gpl-3.0"].split()
    texts = []
    for i in range(80):
        cut, gap = rng.randrange(len(words)), rng.randrange(24)
        parts = words[:cut] + ["gap"] * gap + words[cut + rng.randrange(3):]
        texts.append(" ".join(["x"] * rng.randrange(30) + parts + rng.choice([[], words, ["y"] * 9])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def grams(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    want = []
    template = set(grams(" ".join(words)))
    n = len(template)
    for i, text in enumerate(texts):
        g = grams(text)
        spans = [(len(template & set(g[p:p + 2 * n])), -p) for p in range(len(g)) if g[p] in template]
        good = [s for s in spans if 10 * s[0] >= 8 * n]
        if good:
            want.append((i, max(good)[0] / n, -max(good)[1], len(good)))
    got = sorted((r.doc_id, r.containment, r.start_word, r.n_spans)
                 for r in licenses.license_matches(docs).collect() if r.license == "gpl-3.0")
    assert got == want and 20 < len(want) < 80


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_joins_a_block_in_small_batches():
    from tokenizers import Tokenizer

    vocabulary = open(bpe.vocabulary_path(), encoding="utf-8").read()
    texts = [prose(i, 4_000) for i in range(120)]
    block = bpe._Block()
    for i, text in enumerate(texts):
        block.add(i, text.encode())
    rows = block.row(7, 3, pa.int64())
    parts = rows.column("parts")[0].as_py()
    words = pa.RecordBatch.from_arrays(
        [pa.array([7] * len(parts)), pa.array([x["bucket"] for x in parts]),
         pa.array([x["words"] for x in parts], pa.binary())], ["block", "bucket", "words"])
    coded = pa.Table.from_batches(bpe._word_task(vocabulary)(iter([words])))
    got = bpe._join_task(vocabulary, False)(pa.Table.from_batches([rows]), coded)
    batches = got.to_batches()
    assert len(batches) > 2 and max(b.nbytes for b in batches) < 3 << 20
    assert got["doc_id"].to_pylist() == list(range(120))
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for i in (0, 60, 119):
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert got["ids"][i].as_py() == ids and got["n_tokens"][i].as_py() == len(ids)
        assert got["decoded"][i].as_py() == library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(spark, odd_docs):
    more = ["it's I'LL don't", "a<|endoftext|>b <|ENDOFTEXT|>", "Σ ΑΣ ſ İ ﬁ Å", "x y\u0085z \x1c \x00",
            "中文 字 👩‍👩‍👧 12 ½", "́ ́a"]
    docs = odd_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    tok, texts = library(), [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for doc_id, text in texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    # Small blocks and buckets: most words meet others of many blocks.
    for block, bucket_bytes in ((bpe.BLOCK, bpe.BUCKET_BYTES), (1, 64), (3000, 1 << 40)):
        got = bpe.encode(docs, digest=True, block=block, bucket_bytes=bucket_bytes)
        assert rows(got) == sorted(want, key=repr)
    broken = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF20E4') AS string) AS text")
    got = bpe.encode(broken).first()
    assert got.ids == tok.encode("a\ufffd \ufffd", add_special_tokens=False).ids
    coded = bpe.encode(docs)
    assert rows(bpe.decode(coded)) == rows(coded.select("doc_id", "decoded"))


def test_nothing_comes_of_nothing(no_docs):
    assert quality_rules.quality_rules(no_docs).count() == 0
    assert licenses.license_matches(no_docs).count() == 0
    assert bpe.encode(no_docs).count() == 0
