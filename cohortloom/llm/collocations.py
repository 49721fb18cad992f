"""Phrase collocations from stripes: which words belong together, by language.

Texts, A-Z lowered, are split at punctuation and line ends into pieces and these at spaces and
tabs into words; a phrase is a run of words inside a piece.

1. Stripes.  A stripe belongs to a prefix and counts the words that follow it (Lin and Dyer
   2010).  Tasks count their own rows first and send one stripe a prefix; stripes of a prefix
   are merged elementwise.  The empty prefix counts single words, and its total all words;
   prefixes of one to four words count the longer phrases.
2. A phrase that is met ``min_count`` times consists of phrases that are, too.  So a longer
   prefix is only followed where the phrases at both its ends are frequent.  Tasks tell by a
   table over hashed phrases of at most ``2 ** max_bits`` bytes, however many phrases there
   are; it may let rare ones pass, whose counts then drop them, and never stops a frequent one.
3. A stripe with very many followers is dealt into lanes by the follower's hash: the table
   holds the size class of a prefix, so all tasks agree.  No word, however common, makes one
   task merge an unbounded stripe.
4. From the merged stripes come the extensions (frequent followers), the counts that the cuts
   of a candidate need, and the largest count of a one-word extension, to the right within a
   stripe and to the left across stripes.  A candidate inside any longer phrase of at least
   ``percent`` of its count is also inside a one-word extension of that count, so these settle
   what is dropped.

Counts are longs, products decimals of 38 digits, so scores are exact.

Defined results: a null language counts as ``und``; null and empty texts have no words; rows
that repeat an id count like any other; very long texts are worked in blocks that share their
border words, and never cut; an empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.distributed import union_all
from cohortloom.llm.common import documents, stored

MIN_COUNT = 100
PERCENT = 100
MAX_WORDS = 5
TOP = 2000
NO_LANG = "und"
MAX_BITS = 24                # bytes of the phrase table: 16 MB
BLOCK = 3_000_000            # words counted at once
SLICE = 1 << 20              # bytes split at once
STEP = 1 << 18               # places looked up at once
PARTS = 16                   # a block's phrases are counted in so many parts
WORD_LANES = 1024            # lanes of the empty prefix
LANE_BITS = 16               # a lane takes prefixes of up to 2 ** 17 occurrences whole
MERGE_ROWS = 20_000
SALTS = 256

# Bytes that end a piece, and the letters that are lowered.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_MARK = b"\xff"              # no byte of a UTF-8 text
_TABLE = bytes.maketrans(_UPPER + _ENDS, _LOWER + _MARK * len(_ENDS))
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _hash_word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def phrase_hashes(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """One hash for each phrase, from the hashes of its language and of its words in order."""
    h = langs.copy()
    for w in words:
        h = h * _TIMES + w
    return _mixed(h)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words and piece ends of a text, a slice at a time."""
    body = text.translate(_TABLE)
    at = 0
    while at < len(body):
        end = at + SLICE
        if end < len(body):          # a slice ends before a word, a mark or a blank
            cut = max(body.rfind(b, at, end) for b in (b" ", b"\t", _MARK))
            if cut <= at:
                after = [p for p in (body.find(b, end) for b in (b" ", b"\t", _MARK)) if p >= 0]
                cut = min(after, default=len(body))
            end = cut
        yield body[at:end].replace(_MARK, b" \xff ").split()
        at = end
    yield [_MARK]


# Phrase table ----------------------------------------------------------------------------
class PhraseTable:
    """Size classes (log2 of the count, 0: none) of hashed phrases of one length."""

    def __init__(self, classes: np.ndarray):
        self.classes = classes
        self.shift = np.uint64(64 - (len(classes).bit_length() - 1))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.classes[(hashes >> self.shift).astype(np.int64)]


def _slot_task(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([_hash_word(x.encode()) for x in batch.column(0).to_pylist()], np.uint64)
            phrases = [x.encode().split(b" ") for x in batch.column(1).to_pylist()]
            words = [np.array([_hash_word(w) for w in column], np.uint64) for column in zip(*phrases)]
            slot = phrase_hashes(langs, words) >> np.uint64(64 - bits)
            size = np.log2(batch.column(2).to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot.astype(np.int64), pa.int64()), pa.array(np.maximum(size, 1), pa.int32())],
                ["slot", "size"])

    return run


def phrase_table(frequent: DataFrame, n: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """The table of phrases of one length; ``n`` is their number."""
    bits = min(max_bits, max(10, math.ceil(math.log2(16 * max(n, 1)))))
    rows = (frequent.select("lang", "phrase", "f").mapInArrow(_slot_task(bits), "slot long, size int")
            .groupBy("slot").agg(F.max("size").alias("size")).toArrow())
    classes = np.zeros(1 << bits, np.uint8)
    classes[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return classes


# Stripes ---------------------------------------------------------------------------------
STRIPE_SCHEMA = "lang string, prefix string, lane int, followers binary, counts binary"


class _Block:
    """Words of a task until they are counted."""

    def __init__(self):
        self.parts: list[pa.Array] = []
        self.pending: list[bytes] = []
        self.langs: dict[str, int] = {}
        self.owner: list[tuple[int, int]] = []      # (language, words) in order
        self.size = 0
        self.last: list[bytes] = []

    def add(self, lang: str, found: list[bytes]) -> None:
        self.pending.extend(found)
        self.owner.append((self.langs.setdefault(lang, len(self.langs)), len(found)))
        self.size += len(found)
        self.last = (self.last + found[-MAX_WORDS:])[-MAX_WORDS:]
        if len(self.pending) > 200_000:
            self._settle()

    def _settle(self) -> None:
        self.parts.append(pa.array(self.pending, pa.binary()))
        self.pending = []

    def numbered(self) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of all words in order, -1 at the end of a piece, and the words by number."""
        self._settle()
        coded = pa.chunked_array(self.parts).dictionary_encode().unify_dictionaries()
        self.parts = []
        words = coded.chunk(0).dictionary.to_pylist()
        ids = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        if _MARK in words:
            ids[ids == words.index(_MARK)] = -1
        return ids, words


def _stripes_of(block: _Block, length: int, table: PhraseTable | None, word_lanes: int,
                lane_bits: int) -> Iterator[tuple]:
    """(lang, prefix, lane, followers, counts) of prefixes of ``length`` words.

    The table holds phrases of as many words.  A prefix, or at length 0 a word, is in one of
    ``PARTS`` parts; one part is sorted and counted at a time, which bounds the task's memory.
    """
    ids, words = block.numbered()
    n = len(ids) - length
    if n <= 0:
        return
    lang = np.repeat([o for o, _ in block.owner], [n for _, n in block.owner]).astype(np.int32)
    hashes = np.array([_hash_word(w) for w in words], np.uint64)
    spread = (hashes >> np.uint64(40)).astype(np.int32)
    lang_names = list(block.langs)
    is_word = ids >= 0
    if length:                 # the prefix and the phrase that ends with the follower are frequent
        lang_hash = np.array([_hash_word(x.encode()) for x in lang_names], np.uint64)
        size, part = np.zeros(n + 1, np.uint8), np.zeros(n + 1, np.uint8)
        for a in range(0, n + 1, STEP):
            b = min(a + STEP, n + 1)
            at = a + np.flatnonzero(np.logical_and.reduce([is_word[a + k:b + k] for k in range(length)]))
            h = phrase_hashes(lang_hash[lang[at]], [hashes[ids[at + k]] for k in range(length)])
            size[at], part[at] = table(h), h % np.uint64(PARTS)
        part = np.where((size[:-1] > 0) & (size[1:] > 0), part[:-1], PARTS)
    else:
        part = np.where(is_word, (spread % PARTS).astype(np.uint8)[ids], PARTS)
    for p in range(PARTS):
        at = np.flatnonzero(part == p)
        if len(at):
            lanes = (np.left_shift(1, np.clip(size[at].astype(np.int64) - lane_bits, 0, 12)) if length
                     else np.int64(word_lanes))
            yield from _grouped(ids, lang, at, length, lanes, spread, words, lang_names)


def _grouped(ids: np.ndarray, lang: np.ndarray, at: np.ndarray, length: int, lanes,
             spread: np.ndarray, words: list[bytes], lang_names: list[str]) -> Iterator[tuple]:
    """Stripes of the phrases of ``length + 1`` words that start at the given places."""
    n_words = len(words)
    prefix, where = lang[at].astype(np.int64), None      # exact numbers of (language, prefix)
    for k in range(length):
        prefix = prefix * n_words + ids[at + k]
        if k:
            where, prefix = np.unique(prefix, return_index=True, return_inverse=True)[1:]
    follower = ids[at + length]
    lane = spread[follower] % lanes
    n_lanes = int(lane.max()) + 1
    key, count = np.unique((prefix * n_lanes + lane) * n_words + follower, return_counts=True)
    group, follower = np.divmod(key, n_words)
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(cut[1:], len(group)).tolist()
    prefix, lane = np.divmod(group[cut], n_lanes)
    if length < 2:
        own, one = np.divmod(prefix, n_words) if length else (prefix, prefix)
        heads = [words[i] for i in one.tolist()] if length else [b""] * len(cut)
    else:
        start = at[where[prefix]]
        own = lang[start]
        heads = [b" ".join(p) for p in zip(*([words[i] for i in ids[start + k].tolist()]
                                             for k in range(length)))]
    names = [words[i] for i in follower.tolist()]
    counts = count.astype("<u4").tobytes()
    for o, head, x, a, b in zip(own.tolist(), heads, lane.tolist(), cut.tolist(), ends):
        yield (lang_names[o], head.decode(), x, b" ".join(names[a:b]), counts[4 * a:4 * b])


def _stripe_batches(rows: Iterator[tuple], each: int = 20_000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*held), kinds)],
            ["lang", "prefix", "lane", "followers", "counts"])

    for row in rows:
        held.append(row)
        if len(held) >= each:
            yield batch()
            held = []
    if held:
        yield batch()


def _stripe_task(length: int, classes: np.ndarray | None, block_words: int, word_lanes: int,
                 lane_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if classes is None else PhraseTable(classes)
        block = _Block()

        def counted():
            return _stripe_batches(_stripes_of(block, length, table, word_lanes, lane_bits))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                for found in filter(None, tokens(text.as_buffer().to_pybytes())):
                    block.add(lang, found)
                    if block.size >= block_words:
                        yield from counted()
                        # Its last words may start phrases that end in the next block.
                        border = block.last[-length:] if length else []
                        block = _Block()
                        if border:
                            block.add(lang, border)
        if block.size:
            yield from counted()

    return run


def _merge_task(min_count: int):
    """Stripes arrive sorted by prefix and lane; one merged stripe is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, merged = None, {}

        def close() -> None:
            lang, prefix, _ = key
            if not prefix:           # the total of the empty prefix: all words
                out.append((lang, None, sum(merged.values())))
            ahead = prefix + " " if prefix else ""
            out.extend((lang, ahead + w.decode(), c) for w, c in merged.items() if c >= min_count)

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k)
                 for i, k in enumerate((pa.string(), pa.string(), pa.int64()))],
                ["lang", "phrase", "f"])
            out.clear()
            return rows

        for stripes in batches:
            keys = zip(*(stripes.column(c).to_pylist() for c in ("lang", "prefix", "lane")))
            for k, followers, counts in zip(keys, stripes.column("followers"), stripes.column("counts")):
                if k != key:
                    if key is not None:
                        close()
                        if len(out) >= MERGE_ROWS:
                            yield batch()
                    key, merged = k, {}
                words = followers.as_buffer().to_pybytes().split(b" ")
                numbers = np.frombuffer(counts.as_buffer(), "<u4").tolist()
                if merged:
                    get = merged.get
                    for w, c in zip(words, numbers):
                        merged[w] = get(w, 0) + c
                else:
                    merged = dict(zip(words, numbers))
        if key is not None:
            close()
        yield batch()

    return run


def extensions(rows: DataFrame, length: int, classes: np.ndarray | None, min_count: int = MIN_COUNT,
               block_words: int = BLOCK, word_lanes: int = WORD_LANES, lane_bits: int = LANE_BITS
               ) -> DataFrame:
    """(lang, phrase, f): frequent phrases of ``length + 1`` words, from (lang, text).

    For single words also rows without a phrase, whose counts add up to all words.
    """
    key = ["lang", "prefix", "lane"]
    return (rows.mapInArrow(_stripe_task(length, classes, block_words, word_lanes, lane_bits),
                            STRIPE_SCHEMA)
            .repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(_merge_task(min_count), "lang string, phrase string, f bigint"))


# Scores ----------------------------------------------------------------------------------
def scored(frequent: DataFrame, totals: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer phrase subsumes."""
    words = F.split("phrase", " ")
    long = frequent.withColumn("w", words).filter(F.size("w") > 1)
    size = F.size("w")
    # The largest one-word extension of each phrase, to either side.
    wider = (long.filter(size > 2).select("lang", "f", F.explode(F.array(
        F.concat_ws(" ", F.slice("w", F.lit(1), size - 1)),
        F.concat_ws(" ", F.slice("w", F.lit(2), size - 1)))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("wider")))
    kept = (long.join(wider, ["lang", "phrase"], "left")
            .filter(F.col("wider").isNull() | (100 * F.col("wider") < percent * F.col("f"))))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"),
                       F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), "w").select(
        "lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("first"),
        F.concat_ws(" ", F.slice("w", F.col("k") + 1, size - F.col("k"))).alias("rest"))
    part = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    other = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))

    # 4 + 15 + 18 digits and 18 + 18 digits stay below 38.
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(18,0)) "
                   "div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")
    return (cuts.join(part, ["lang", "first"]).join(other, ["lang", "rest"]).join(totals, "lang")
            .groupBy("lang", "phrase", "a", "n").agg(least)
            .select("lang", "phrase", "a", "s.l", "s.r", "n", F.col("s.score").alias("score")))


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each language; no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    few = rows.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS))).withColumn(
        "rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(
        F.col("rank") <= top)
    return few.drop("salt").withColumn(
        "rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(
        F.col("rank") <= top)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, percent: int = PERCENT,
                 top: int = TOP, text: str = "text", lang: str = "lang",
                 block_words: int = BLOCK, word_lanes: int = WORD_LANES,
                 lane_bits: int = LANE_BITS, max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best collocations of each language."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.col(text).cast("string").alias("text"))
    levels, classes = [], None
    for length in range(MAX_WORDS):
        found = stored(extensions(rows, length, classes, min_count, block_words, word_lanes, lane_bits))
        levels.append(found)
        n = found.filter(F.col("phrase").isNotNull()).count()
        if not n:
            break
        if length + 1 < MAX_WORDS:
            classes = phrase_table(found.filter(F.col("phrase").isNotNull()), n, max_bits)
    totals = levels[0].filter(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = union_all(levels).filter(F.col("phrase").isNotNull())
    chosen = stored(scored(frequent, totals, percent))
    return best(chosen, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, unnest(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), "
    f"lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase, {k} AS size FROM pieces"
    for k in range(1, MAX_WORDS + 1))
_CUTS = " UNION ALL ".join(
    f"SELECT lang, phrase, a, w, {k} AS k, array_to_string(w[1:{k}], ' ') AS first, "
    f"array_to_string(w[{k + 1}:], ' ') AS rest FROM kept WHERE len(w) > {k}"
    for k in range(1, MAX_WORDS))

SQL = f"""
WITH texts AS (SELECT coalesce(lang, '{NO_LANG}') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     parts AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS part
               FROM texts),
     pieces AS (SELECT lang, regexp_extract_all(part, '[^\\x20\\x09]+') AS w FROM parts),
     grams AS ({_GRAMS}),
     counted AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL),
     total AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
     frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= {MIN_COUNT}),
     longer AS (SELECT * FROM frequent WHERE size > 1),
     kept AS (SELECT lang, phrase, f AS a, w FROM longer c WHERE NOT EXISTS (
                SELECT 1 FROM longer d WHERE d.lang = c.lang AND d.size > c.size
                AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')
                AND 100 * d.f >= {PERCENT} * c.f)),
     cuts AS ({_CUTS}),
     scores AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n,
                  (1000::HUGEINT * c.a * t.n // (l.f::HUGEINT * r.f))::BIGINT AS score
                FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = c.first
                JOIN frequent r ON r.lang = c.lang AND r.phrase = c.rest
                JOIN total t ON t.lang = c.lang),
     least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o
               FROM scores),
     ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang
                  ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank,
                  phrase, a, l, r, n, score FROM least WHERE o = 1)
SELECT * FROM ranked WHERE rank <= {TOP}"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLE = {"op11_collocations": SQL}
