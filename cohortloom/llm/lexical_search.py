"""Ranked lexical search: the best documents of every query text, by NRA.

Terms are maximal runs of digits, letters and characters beyond ASCII, with A-Z lowered.

1. Documents are read once, in blocks of up to ``block_docs`` rows.  A block is a shard of the
   index: its documents with their numbers of terms, and for each term that may occur in a
   query one row with the documents that hold it.  What may occur is told by a bit table of
   fixed size over hashed query terms, so a term of a query is never missed.
2. Numbers of documents and terms, and the documents that hold a term, are counted from the
   shards; each query becomes (term, weight) rows.
3. Shards are dealt into lanes, and every lane meets all queries, block by block.  In a shard
   each term's list is sorted by impact.  A query reads its lists side by side from the top and
   keeps for each document a lower bound (the impacts read) and an upper bound (what the
   unread lists could add).  It reads on until no other document, seen or not, can reach the
   last place or tie with it, and the bounds of all that can have met (NRA, Fagin, Lotem and
   Naor 2001).  The last place of earlier shards of the lane is the bar for the next ones.
4. The best rows of all lanes meet per query; each task passes on no more than ``k`` a query.

Scores are integers, so results don't depend on the order of additions.

Defined results: null and empty texts have no terms and are no documents of the statistics;
rows that repeat an id are documents of their own; a null doc_id ranks after all other ids of
its score; rows that repeat an item and its text count once, different texts of one item
count together; a null item_id is an item like any other; items without terms that occur get
no row; an empty table gives no rows; very long texts are read whole; other columns stay out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.llm.common import documents, stored

K = 10
BLOCK_DOCS = 8192
BLOCK_TERMS = 3_000_000      # occurrences in a block, beyond the document that reaches it
MAX_WORDS = 400_000          # distinct terms that a task remembers
SLOT_BITS = 24               # the bit table of query terms: 2 MB
BLOCK_QUERIES = 1 << 18      # query terms that a lane holds at once
FIRST_READ = 128

# Bytes that separate terms, and the letters that are lowered.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61),
                     *range(0x7B, 0x80)])
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _LOWER)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return text.translate(_TABLE).split()


def _bodies(column: pa.Array) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column)


# Queries ---------------------------------------------------------------------------------
def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, t.decode()) for i, body in zip(batch.column(0).to_pylist(),
                                                    _bodies(batch.column(1)))
                 for t in terms(body)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in found], pa.int64()),
             pa.array([t for _, t in found], pa.string())], ["item", "term"])


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times)."""
    rows = items.select(F.col(item_id).cast("long").alias("item"),
                        F.col(text).cast("string").alias("text")).distinct()
    return (rows.mapInArrow(_query_rows, "item bigint, term string")
            .groupBy("item", "term").agg(F.count("*").alias("times")))


def _slot(term: bytes) -> int:
    return zlib.crc32(term) >> (32 - SLOT_BITS)


def term_bits(queries: DataFrame) -> bytes:
    """The bit table of the queries' terms; its size is fixed, however many there are."""
    slot = F.shiftright(F.crc32("term"), 32 - SLOT_BITS).cast("int").alias("slot")
    bits = np.zeros(1 << SLOT_BITS, np.bool_)
    bits[queries.select(slot).distinct().toArrow().column(0).to_numpy()] = True
    return np.packbits(bits).tobytes()


# Index -----------------------------------------------------------------------------------
INDEX_SCHEMA = "shard bigint, term string, n int, total bigint, docs binary, vals binary"


class _Words(dict):
    """Numbers of terms: 0 for those of no query."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits, self.names = bits, [b""]

    def __missing__(self, word: bytes) -> int:
        slot = _slot(word)
        number = 0
        if self.bits[slot >> 3] >> (7 - (slot & 7)) & 1:
            number = len(self.names)
            self.names.append(word)
        self[word] = number
        return number


def _index_task(bits: bytes, block_docs: int, block_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 33, 0
        words = _Words(np.frombuffer(bits, np.uint8))
        ids: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        n_terms = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(h) for h in held], np.int64)
            owner = np.repeat(np.arange(len(held), dtype=np.int64), lengths)
            flat = np.concatenate(held) if held else np.empty(0, np.int64)
            pair, tf = np.unique(flat * len(ids) + owner, return_counts=True)
            number, doc = np.divmod(pair, len(ids))
            cut = np.flatnonzero(np.diff(number, prepend=-1))
            ends = np.append(cut[1:], len(number))
            docs, tfs = doc.astype("<i4"), tf.astype("<i4")
            rows = [(None, sum(n > 0 for n in sizes), sum(sizes),
                     np.array([-1 if i is None else i for i in ids], "<i8").tobytes()
                     + np.array([i is not None for i in ids], np.uint8).tobytes(),
                     np.array(sizes, "<i8").tobytes())]
            rows += [(words.names[number[a]].decode(), int(b - a), 0, docs[a:b].tobytes(),
                      tfs[a:b].tobytes()) for a, b in zip(cut.tolist(), ends.tolist())]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([part + made] * len(rows), pa.int64()),
                 *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                ["shard", "term", "n", "total", "docs", "vals"])

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), _bodies(batch.column(1))):
                found = terms(body)
                numbers = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
                ids.append(doc_id)
                sizes.append(len(found))
                held.append(numbers[numbers > 0])
                n_terms += len(found)
                if len(ids) >= block_docs or n_terms >= block_terms:
                    yield flush()
                    made += 1
                    ids, sizes, held, n_terms = [], [], [], 0
                    if len(words) > MAX_WORDS:
                        words = _Words(words.bits)
        if ids:
            yield flush()

    return run


def index(docs: DataFrame, bits: bytes, doc_id: str = "doc_id", text: str = "text",
          block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row for each shard and term; the row without a term holds the shard's documents."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text")).mapInArrow(
        _index_task(bits, block_docs, block_terms), INDEX_SCHEMA)


# Search ----------------------------------------------------------------------------------
def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, bar: int, k: int
        ) -> tuple[np.ndarray, np.ndarray]:
    """(documents, exact scores) of all that can be among the best ``k`` and reach ``bar``.

    A list holds documents and positive impacts, largest first.
    """
    lower = np.zeros(n_docs, np.int64)
    seen = np.zeros((len(lists), n_docs), np.int64)
    at, step, alive = 0, FIRST_READ, None
    frontier = np.array([gains[0] for _, gains in lists], np.int64)
    bar = max(bar, 1)
    if frontier.sum() < bar:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    while True:
        for i, (docs, gains) in enumerate(lists):
            if at < len(docs):
                block = docs[at:at + step]
                lower[block] += gains[at:at + step]
                seen[i, block] = 1
                frontier[i] = gains[at + step] if at + step < len(docs) else 0
        at, step = at + step, 2 * step
        closed = alive is not None
        if not closed:
            alive = np.flatnonzero(lower)
        known = lower[alive]
        if len(alive) >= k:
            bar = max(bar, int(np.partition(known, len(known) - k)[len(known) - k]))
        could_add = frontier.sum() - frontier @ seen[:, alive]
        near = known + could_add >= bar
        alive, could_add = alive[near], could_add[near]
        if frontier.sum() < bar:     # no document that was not met yet gets in
            if not could_add.any():
                return alive, lower[alive]
        elif not closed:
            alive = None


def _gains(docs: bytes, tfs: bytes, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A term's documents by descending impact for a weight of 1."""
    doc = np.frombuffer(docs, "<i4").astype(np.int64)
    tf = np.frombuffer(tfs, "<i4").astype(np.int64)
    gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    order = np.argsort(-gain, kind="stable")
    return doc[order], gain[order]


class _Lane:
    """Best rows of the queries of one lane and block."""

    def __init__(self, k: int):
        self.k = k
        self.queries: dict = {}
        self.best: dict = {}

    def add_query(self, item, term: str, weight: int) -> None:
        self.queries.setdefault(item, []).append((term, weight))

    def search(self, ids: list, n_docs: int, lists: dict) -> None:
        for item, wanted in self.queries.items():
            mine = [(lists[t][0], lists[t][1] * w) for t, w in wanted if t in lists]
            if not mine:
                continue
            best = self.best.get(item, [])
            bar = -best[-1][0] if len(best) == self.k else 0
            docs, scores = nra(mine, n_docs, bar, self.k)
            if len(docs):
                best = best + [(-s, ids[d] is None, ids[d] or 0) for s, d in zip(
                    scores.tolist(), docs.tolist())]
                best.sort()
                self.best[item] = best[:self.k]

    def rows(self) -> pa.RecordBatch:
        out = [(item, None if none else doc, -s) for item, best in self.best.items()
               for s, none, doc in best]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.int64()) for i in range(3)],
            ["item_id", "doc_id", "score"])


def _search_task(n_docs: int, n_terms: int, k: int):
    """Rows arrive sorted by lane, block and shard: a lane's queries, then its shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lane, shard = None, _Lane(k), None
        ids: list = []
        m, lists = np.empty(0, np.int64), {}
        wanted: set = set()
        for batch in batches:
            columns = [batch.column(c).to_pylist()
                       for c in ("lane", "block", "shard", "term", "item", "weight")]
            docs, vals = batch.column("docs"), batch.column("vals")
            for r, (a, b, s, term, item, weight) in enumerate(zip(*columns)):
                if (a, b, s) != (*(key or ()), shard):
                    if shard is not None and shard >= 0:
                        lane.search(ids, len(ids), lists)
                    if (a, b) != key:
                        if key is not None:
                            yield lane.rows()
                        key, lane, wanted = (a, b), _Lane(k), set()
                    shard, lists = s, {}
                if s < 0:
                    if weight > 0:
                        lane.add_query(item, term, weight)
                        wanted.add(term)
                elif term is None:
                    n = np.frombuffer(vals[r].as_buffer(), "<i8").astype(np.int64)
                    raw = docs[r].as_buffer().to_pybytes()
                    known = np.frombuffer(raw[8 * len(n):], np.uint8)
                    ids = [i if ok else None for i, ok in zip(
                        np.frombuffer(raw[:8 * len(n)], "<i8").tolist(), known.tolist())]
                    m = 25 + (75 * n * n_docs) // n_terms
                elif term in wanted:
                    lists[term] = _gains(docs[r].as_buffer().to_pybytes(),
                                         vals[r].as_buffer().to_pybytes(), m)
        if key is not None:
            if shard is not None and shard >= 0:
                lane.search(ids, len(ids), lists)
            yield lane.rows()

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id",
           text: str = "text", item_id: str = "item_id", item_text: str = "text",
           block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS,
           block_queries: int = BLOCK_QUERIES, lane_rows: int = 1 << 14) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    queries = stored(query_terms(items, item_id, item_text))
    shards = stored(index(docs, term_bits(queries), doc_id, text, block_docs, block_terms))
    size = shards.agg(F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("docs"),
                      F.sum("total").alias("terms"), F.count("*").alias("rows"),
                      F.count_if(F.col("term").isNull()).alias("shards")).first()
    n_docs, n_terms = size["docs"] or 0, size["terms"] or 0
    held = shards.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1))))
    weighted = queries.join(held, "term").select(
        "item", "term", (weight * F.col("times")).cast("long").alias("weight"))
    blocks = max(1, math.ceil(queries.count() / block_queries))
    lanes = max(1, min(size["shards"], max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                           math.ceil(size["rows"] / lane_rows))))

    def everywhere(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = weighted.withColumn("block", F.pmod(F.hash("item"), F.lit(blocks))).select(
        "*", everywhere(lanes).alias("lane"), F.lit(-1).cast("long").alias("shard"))
    read = shards.select("shard", "term", "docs", "vals",
                         F.pmod(F.hash("shard"), F.lit(lanes)).alias("lane"),
                         everywhere(blocks).alias("block"))
    best = (read.unionByName(asked, allowMissingColumns=True)
            .repartition(lanes, "lane", "block")
            .sortWithinPartitions("lane", "block", "shard", "term")
            .mapInArrow(_search_task(n_docs, max(n_terms, 1), k),
                        "item_id bigint, doc_id bigint, score bigint"))
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
     tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (
              SELECT r, doc_id, unnest(regexp_extract_all({_LOWERED}, '{_PATTERN}')) AS term
              FROM docs) GROUP BY r, doc_id, term),
     sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
     total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
     asked AS (SELECT item_id, term, count(*) AS times FROM (
                 SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{_PATTERN}')) AS term
                 FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
     held AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     weighted AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
                  FROM held, total),
     scored AS (SELECT a.item_id, t.r, t.doc_id, sum(a.times * w.w * (
                  (1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * s.n * g.docs) // g.terms)))
                  )::BIGINT AS score
                FROM asked a JOIN weighted w USING (term) JOIN tf t USING (term)
                JOIN sizes s ON s.r = t.r, total g GROUP BY a.item_id, t.r, t.doc_id),
     ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id
                  ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
                FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {K}"""

QUERIES = {"op13_lexical_search": op13_lexical_search}
ORACLE = {"op13_lexical_search": SQL}
