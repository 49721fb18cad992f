"""The corpus pipeline against the same chain in plain Python."""

import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from cohortloom.llm import bpe, mixing
from cohortloom.llm.quality_rules import BOILERPLATE, MARKS, SEPARATORS, SYMBOLS
from tests.conftest import SMALL
from tests.llm.conftest import PASSAGE, prose
from tests.llm.test_corpus_operators import n_words, slow_targets
from tests.llm.test_duplicates import slow_simhash
from tests.llm.test_text_operators import WORD, base_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def line_fails(line):
    words = WORD.findall(line)
    solid = sum(map(len, words))
    marked = {k: sum(c in chars for c in line) for k, chars in
              (("symbols", SYMBOLS), ("separators", SEPARATORS), ("marks", MARKS), ("shouts", "!"))}
    return bool(words) and (
        100 * marked["symbols"] > 10 * solid or 100 * marked["shouts"] > 5 * solid
        or marked["separators"] >= 2 and 100 * marked["separators"] > 20 * len(words)
        or len(words) >= 30 and not marked["marks"]
        or len(words) <= 12 and any(p in line.lower() for p in BOILERPLATE))


def slow_rules(rows):
    out = []
    for i, text, source in rows:
        n, chars, _, _, repeated = base_counts(text)
        lines = (text or "").split("\n")
        lost = sum(len("".join(WORD.findall(x))) for x in lines if line_fails(x))
        if n >= 10 and 100 * repeated <= 20 * n and 100 * lost <= 30 * chars:
            out.append((i, "\n".join(x for x in lines if not line_fails(x)), source))
    return out


def slow_near_duplicates(rows):
    low = {c for _, _, c in slow_simhash([(i, t) for i, t, _ in rows])}
    return [r for r in rows if r[0] in low]


def slow_passages(rows, length=200, words=51):
    raw = [t.encode() for _, t, _ in rows]
    often = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (i, _, source), b in zip(rows, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if often[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept, k = b"", 0
        while k < len(b):
            end = k
            while end < len(b) and gone[end] == gone[k]:
                end += 1
            if not gone[k] or len(b[k:end].split()) < words:
                kept += b[k:end]
            k = end
        out.append((i, kept.decode("utf-8", "ignore"), source))
    return out


@pytest.fixture(scope="module")
def fixture_rows():
    texts = {i: prose(100 + i, 60 + 13 * i) for i in range(30)}
    texts |= {40: texts[3], 41: texts[4] + " more words", 42: prose(50, 40) + "\n" + PASSAGE,
              43: PASSAGE + "\n" + prose(51, 40), 44: "Home | News | Help | More\n" * 30, 45: "", 46: "one two",
              47: texts[5] + "\nPrivacy policy\n" + prose(52, 30), 48: "spam ham " * 200, 49: prose(53, 2000),
              50: "Ünï " + prose(54, 90), 51: "\n".join(prose(55, 45).split("\n")) + "\n" + prose(56, 50),
              52: prose(55, 45) + "\n" + prose(57, 50)}
    return [(i, t, ("a", "b", None)[i % 3]) for i, t in texts.items()]


def test_stages_equal_a_plain_chain(spark, fixture_rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in fixture_rows], SCHEMA).repartition(3)
    rows = fixture_rows
    for (_, stage), slow in zip(corpus_pipeline.STAGES, (slow_rules, slow_near_duplicates, slow_passages)):
        docs, rows = stage(spark, docs, SMALL), slow(rows)
        assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == sorted(rows)
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    mixed = corpus_pipeline.mix(spark, docs, SMALL)
    sizes, text_of = defaultdict(int), {i: t for i, t, _ in rows}
    for _, t, s in rows:
        sizes[s] += n_words(t)
    target, taken = slow_targets(sizes), defaultdict(int)
    for r in mixed.collect():
        assert r.text == text_of[r.doc_id]
        taken[r.source] += n_words(r.text)
    longest = max(n_words(t) for _, t, _ in rows)
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= math.ceil(mixing.CAP)
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.vocabulary_path())
    coded = corpus_pipeline.encode(spark, mixed, SMALL).collect()
    assert Counter(r.doc_id for r in coded) == copies
    for r in coded:
        ids = library.encode(text_of[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_pipeline_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.count()
            docs = stage(spark, docs, SMALL)
            if i < 4:
                assert docs.columns == list(corpus_pipeline.COLUMNS)
                assert i == 3 or docs.count() <= before
            else:
                assert docs.count() == before


def test_texts_reach_python_in_small_batches(spark):
    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(4000, numPartitions=1).selectExpr(
        "id as doc_id", "repeat('word ', 800) as text", "'en' as lang", "'a' as source",
        "4000L as n_chars")
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.drop_repeats,
                  corpus_pipeline.encode):
        stage(spark, docs, SMALL)
        sizes = [r.n for r in docs.select("text").mapInArrow(count, "n bigint").collect()]
        assert sum(sizes) == 4000 and max(sizes) <= 1100
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))
