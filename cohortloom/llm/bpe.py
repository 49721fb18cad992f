"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII blanks, which no token crosses: the vocabulary's
normaliser and pre-tokenizer treat the pieces between blanks alike wherever they
stand, so the ids of a text are the ids of its words in order.

1. Tasks split the texts.  Consecutive rows make a block of about ``BLOCK`` bytes,
   which becomes one stored row: its distinct words, dealt into buckets by their
   checksum, with their counts, and each text as ranks of words, commonest first.
2. Words meet by bucket, each once for every block that holds it, so that no word
   is frequent there.  A bucket's distinct words are encoded once in the whole job;
   the ids of a block's words go back in the order in which the words came.
3. Blocks meet the ids of their words, which are joined to the texts by position.
   Pieces come from the id-to-piece table, which has the fixed size of the vocabulary
   and is sent with the task, as a broadcast join would.

There is a bucket for every ``BUCKET_BYTES`` of text, so that the words of a bucket fit a
task, whatever the corpus.  What travels is packed by zstandard.  Lost tasks are redone
from the stored blocks.

Defined results: a null text is encoded like the empty one (no ids, empty
decoded text); very long texts and words are encoded whole; bytes that are no UTF-8
are read as U+FFFD; ids of rows and repeated rows are passed through; other columns
stay out.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import documents, stored

BLOCK = 32 << 20         # bytes of the texts of a block
BUCKET_BYTES = 8 << 20   # bytes of text for each bucket of words
OUT = 1 << 20            # bytes of a batch that leaves a task
WORDS = 4_000            # words that the tokenizer gets at once


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=1)
def _pieces(vocabulary: str) -> list[bytes]:
    """The piece of every id."""
    tokenizer = _tokenizer(vocabulary)
    n = tokenizer.get_vocab_size(with_added_tokens=True)
    return [(tokenizer.id_to_token(i) or "").encode() for i in range(n)]


def _id_type(vocabulary: str) -> str:
    return "<u2" if len(_pieces(vocabulary)) <= 1 << 16 else "<u4"


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 6)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Block:
    """Texts as numbers of words, which are counted in the order in which they come."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        self.keys, self.texts, self.held = [], [], 0

    def add(self, key, text: bytes) -> None:
        words = text.split()
        self.keys.append(key)
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.held += len(text)

    def row(self, block: int, buckets: int, kind: pa.DataType) -> pa.RecordBatch:
        words, flat = list(self.numbers), np.concatenate(self.texts)
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        bucket = np.fromiter((crc32(words[i]) % buckets for i in order.tolist()), np.int64, len(words))
        by_bucket = np.argsort(bucket, kind="stable")
        order, bucket = order[by_bucket], bucket[by_bucket]
        counts = np.bincount(flat, minlength=len(words))[order]
        rank = np.empty(len(words), np.uint32)
        rank[order[np.argsort(-counts, kind="stable")]] = np.arange(len(words), dtype=np.uint32)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        lists = [{"bucket": int(bucket[a]), "words": zstandard.compress(
            b"\n".join([words[i] for i in order[a:b].tolist()]), 9)}
            for a, b in zip(starts, [*starts[1:], len(words)])]
        parts = pa.list_(pa.struct([("bucket", pa.int64()), ("words", pa.binary())]))
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([self.keys], pa.list_(kind)),
             pa.array([[len(t) for t in self.texts]], pa.list_(pa.int64())),
             pa.array([_pack(counts)]), pa.array([_pack(rank[flat])]), pa.array([lists], parts)],
            ["block", "keys", "sizes", "counts", "ranks", "parts"])


def _split_task(buckets: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, block = count(TaskContext.get().partitionId() << 32), _Block()
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(key, value.as_buffer().to_pybytes() if value.is_valid else b"")
                if block.held >= limit:
                    yield block.row(next(numbers), buckets, kind)
                    block = _Block()
        if block.keys:
            yield block.row(next(numbers), buckets, kind)

    return run


def _word_task(vocabulary: str):
    """Rows in the order of their buckets; every distinct word of a bucket is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, kind = _tokenizer(vocabulary), np.dtype(_id_type(vocabulary))
        known, bucket = {}, None
        lengths, ids = [], []

        def coded_rows(batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
            n = len(ids)
            rows = pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                 pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())],
                ["block", "bucket", "lengths", "ids"])
            lengths.clear()
            ids.clear()
            return rows

        for batch in batches:
            first, held = 0, 0
            for at, packed in zip(batch.column(1).to_pylist(), batch.column(2)):
                if at != bucket:
                    known, bucket = {}, at
                words = zstandard.decompress(packed.as_py()).split(b"\n")
                fresh = [w for w in words if w not in known]
                for i in range(0, len(fresh), WORDS):
                    part = fresh[i:i + WORDS]
                    coded = tokenizer.encode_batch_fast(
                        [w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
                    known.update((w, np.array(c.ids, kind).tobytes()) for w, c in zip(part, coded))
                found = [known[w] for w in words]
                lengths.append(_pack(np.fromiter(map(len, found), np.uint32, len(found)) // kind.itemsize))
                ids.append(zstandard.compress(b"".join(found), 9))
                held += len(ids[-1]) + len(lengths[-1])
                if held >= OUT:
                    done = first + len(ids)
                    yield coded_rows(batch, first)
                    first, held = done, 0
            if ids:
                yield coded_rows(batch, first)

    return run


def _join_task(vocabulary: str, digest: bool):
    """A block's texts and the ids of its words: a row for each text.

    Rows become a batch every ``OUT`` bytes, so that neither side holds them twice.
    """
    def batch(keys: pa.Array, n_tokens: list, codes: list, texts: list) -> pa.RecordBatch:
        if digest:
            last = [pa.array(codes, pa.string()), pa.array(texts, pa.string())]
        else:
            ends = pa.array(np.cumsum([0, *n_tokens]), pa.int32())
            last = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(codes).view(np.int32))),
                    pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(n_tokens, pa.int64()), *last],
            ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest
                                     else ("ids", "decoded"))])

    def run(blocks: pa.Table, coded: pa.Table) -> pa.Table:
        block = blocks.drop_columns(["keys"]).to_pylist()[0]
        ranks = _unpack(block["ranks"])
        # Counts and ids come by bucket, the texts speak of words by rank.
        common = np.argsort(-_unpack(block["counts"]).astype(np.int64), kind="stable")
        coded = coded.sort_by("bucket")
        lengths = np.concatenate([np.empty(0, np.int64), *map(_unpack, coded["lengths"].to_pylist())])
        starts, lengths = (np.cumsum(lengths) - lengths)[common], lengths[common]
        ids = np.frombuffer(b"".join(map(zstandard.decompress, coded["ids"].to_pylist())),
                            _id_type(vocabulary)).astype("<u4")
        pieces = list(map(_pieces(vocabulary).__getitem__, ids.tolist()))
        words = [b" ".join(pieces[s:s + n]) for s, n in zip(starts.tolist(), lengths.tolist())]
        keys = blocks["keys"].combine_chunks().flatten()
        out, n_tokens, codes, texts, at, first, held = [], [], [], [], 0, 0, 0
        for row, size in enumerate(block["sizes"], 1):
            text = ranks[at:at + size]
            at += size
            n = lengths[text]
            ends = np.cumsum(n)
            total = int(ends[-1]) if size else 0
            own = ids[np.repeat(starts[text] - (ends - n), n) + np.arange(total)]
            whole = b" ".join(filter(None, map(words.__getitem__, text.tolist())))
            n_tokens.append(total)
            codes.append(hashlib.sha256(own.tobytes()).hexdigest() if digest else own)
            texts.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode("utf-8"))
            held += 128 if digest else len(whole) + 4 * total
            if held >= OUT or row == len(block["sizes"]):
                out.append(batch(keys.slice(first, row - first), n_tokens, codes, texts))
                n_tokens, codes, texts, first, held = [], [], [], row, 0
        return pa.Table.from_batches(out)

    return run


def encode(docs: DataFrame, path: str | None = None, digest: bool = False,
           doc_id: str = "doc_id", text: str = "text", block: int = BLOCK,
           bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or with ``digest`` the SHA-256 of the last two."""
    vocabulary = Path(path or vocabulary_path()).read_text(encoding="utf-8")
    picked = docs.select(F.col(doc_id).alias("doc_id"),
                         F.col(text).cast("string").cast("binary").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = stored(picked.mapInArrow(
        _split_task(size // bucket_bytes + 1, block),
        f"block bigint, keys array<{kind}>, sizes array<bigint>, counts binary, ranks binary, "
        "parts array<struct<bucket: bigint, words: binary>>"))
    words = blocks.select("block", F.explode("parts").alias("part")).select("block", "part.*")
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _word_task(vocabulary), "block bigint, bucket bigint, lengths binary, ids binary")
    last = ("ids_sha256 string, decoded_sha256 string" if digest
            else "ids array<int>, decoded string")
    return (blocks.drop("parts").groupBy("block").cogroup(coded.groupBy("block"))
            .applyInArrow(_join_task(vocabulary, digest),
                          f"doc_id {kind}, n_tokens bigint, {last}"))


def _decoder(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array([p.decode() for p in _pieces(vocabulary)])
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
            found = pieces.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
            ends = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])])
            texts = [" ".join(p for p in found.slice(a, b - a).to_pylist() if p is not None)
                     for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             ["doc_id", "decoded"])

    return run


def decode(coded: DataFrame, path: str | None = None, doc_id: str = "doc_id",
           ids: str = "ids") -> DataFrame:
    """(doc_id, decoded): ids joined to the id-to-piece table, pieces between blanks.

    An id outside the vocabulary has no piece and is left out; null ids give an
    empty text.
    """
    vocabulary = Path(path or vocabulary_path()).read_text(encoding="utf-8")
    picked = coded.select(F.col(doc_id).alias("doc_id"),
                          F.col(ids).cast("array<bigint>").alias("ids"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(_decoder(vocabulary), f"doc_id {kind}, decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), digest=True)


QUERIES = {"op9_bpe": op9_bpe}
ORACLE: dict[str, str] = {}
