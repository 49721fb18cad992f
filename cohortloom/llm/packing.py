"""Packing documents into windows of a fixed number of tokens, online, by sums of squares.

A document's tokens, with an end token, fill whole windows first; what is left is one item.
Items come one by one.  A level array counts the open windows by fill level; an item goes to
the level, or into a new window, that leaves the smallest sum of squared counts (Csirik et
al. 2006), the fullest of equals.  A window whose fill is a power of two needs no padding and
counts nothing; a full one is closed.

Each task packs its own rows with a level array of its own, so nothing is shuffled, and a task
that is run again gives the same windows.  At most ``max_open`` windows are open: where an
item would open one more, its beginning fills the fullest window and the rest goes on.  At
the end, open windows that would need padding are taken apart, the least filled first, to
fill up the fullest; what then remains of one window is cut at powers of two.  No window is
padded.

Defined results: a null text is an empty one, which is its end token alone; very long texts
are encoded whole; rows that repeat an id, and null ids, are documents of their own; an empty
table gives no rows; other columns stay out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.bpe import vocabulary_path
from cohortloom.llm.common import documents

LENGTH = 2048
END = 1
MAX_OPEN = 2048
_EMIT = 20_000   # pieces in a batch


# Token ids -------------------------------------------------------------------------------
def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(c): b for b, c in [*zip(shown, shown), *((b, 256 + i) for i, b in enumerate(hidden))]}


def _ranked(model: dict, special: set[str]) -> dict[bytes, int] | None:
    """Ids by token bytes, if merges are taken in the order of ids; else None."""
    letters = _byte_letters()
    try:
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()
                 if t not in special}
    except KeyError:
        return None
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    made = [model["vocab"].get(a + b) for a, b in pairs]
    return ranks if None not in made and made == sorted(made) else None


def encoder(vocabulary: str):
    """A function from a text to its token ids, equal to the tokenizers library's."""
    spec = json.loads(vocabulary)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    pre, plain = spec.get("pre_tokenizer") or {}, not spec.get("normalizer")
    byte_level = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                  and pre.get("use_regex", True))
    ranks = _ranked(spec["model"], set(added)) if plain and byte_level else None
    exact = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word"))
                for t in spec.get("added_tokens", ()))
    if ranks and exact:
        import public_tokenizers
        import tiktoken

        coder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN,
                                  mergeable_ranks=ranks, special_tokens=added)
        return lambda text: coder.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(vocabulary)
    library.no_truncation()
    library.no_padding()
    return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)


# Windows ---------------------------------------------------------------------------------
class Packer:
    """Windows of one task.

    A piece is (document, start, ids, tokens of the document).  A window is the list of its
    pieces; a closed one goes to ``done`` with its number.
    """

    def __init__(self, length: int = LENGTH, max_open: int = MAX_OPEN, first: int = 0):
        self.length, self.max_open, self.number = length, max_open, first
        self.count = np.zeros(length + 1, np.int64)       # the level array
        self.windows: list[list] = [[] for _ in range(length + 1)]
        self.n_open = 0
        level = np.arange(length + 1)
        self.counted = (level & (level - 1) != 0) & (level < length)
        self.done: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for piece in pieces:
            self.done.append((*piece, self.number, at))
            at += len(piece[2])
        self.number += 1

    def _choose(self, n: int) -> int:
        """The level that an item of ``n`` tokens goes to; 0 is a new window."""
        low, high = self.count[1:self.length - n + 1], self.count[n + 1:]
        change = (np.where(self.counted[n + 1:], 2 * high + 1, 0)
                  - np.where(self.counted[1:self.length - n + 1], 2 * low - 1, 0))
        change = np.where(low > 0, change, np.iinfo(np.int64).max)[::-1]
        if len(change):
            best = int(change.argmin())
            level = len(change) - best
            new = 2 * self.count[n] + 1 if self.counted[n] else 0
            if self.count[level] and (change[best] <= new or self.n_open >= self.max_open):
                return level
        return 0

    def _put(self, level: int, piece: tuple) -> None:
        if level:
            pieces = self.windows[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += len(piece[2])
        if level == self.length:
            self.close(pieces)
        else:
            self.windows[level].append(pieces)
            self.count[level] += 1
            self.n_open += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.length * self.length
        for at in range(0, whole, self.length):
            self.close([(doc, at, ids[at:at + self.length], total)])
        at = whole
        while at < total:
            level = self._choose(total - at)
            if not level and self.n_open >= self.max_open:
                level = int(np.flatnonzero(self.count)[-1])
            end = min(total, at + self.length - level)
            self._put(level, (doc, at, ids[at:end].copy(), total))
            at = end

    def finish(self) -> None:
        """Close all windows; those that need padding are joined by cutting."""
        rest = []
        for level, windows in enumerate(self.windows):
            for pieces in windows:
                if self.counted[level]:
                    rest.append((level, pieces))
                else:
                    self.close(pieces)
        low, high = 0, len(rest) - 1       # rest is sorted by level
        while low < high:
            (have, spare), (level, pieces) = rest[low], rest[high]
            while level < self.length and spare:
                doc, start, ids, total = spare.pop()
                room = self.length - level
                if len(ids) > room:        # the end moves, the beginning stays
                    spare.append((doc, start, ids[:-room], total))
                    start, ids = start + len(ids) - room, ids[-room:]
                pieces.append((doc, start, ids, total))
                level, have = level + len(ids), have - len(ids)
            rest[low], rest[high] = (have, spare), (level, pieces)
            if level == self.length:
                self.close(pieces)
                high -= 1
            if not spare:
                low += 1
        if low == high:
            self._cut(rest[low][1])

    def _cut(self, pieces: list) -> None:
        """Windows of powers of two, largest first."""
        left = sum(len(p[2]) for p in pieces)
        queue = pieces[::-1]
        while left:
            room, window = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, total = queue.pop()
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    queue.append((doc, start + room, ids[room:], total))
                room -= len(window[-1][2])
            self.close(window)


def _pack_task(vocabulary: str, length: int, end: int, max_open: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        packer = Packer(length, max_open, TaskContext.get().partitionId() << 33)

        def emit(kind: pa.DataType) -> pa.RecordBatch:
            done, packer.done = packer.done, []
            docs, starts, ids, totals, numbers, offsets = map(list, zip(*done))
            lengths = [len(x) for x in ids]
            if digest:
                last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
            else:
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                last = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, kind), *(pa.array(c, pa.int64()) for c in (
                    starts, lengths, totals, numbers, offsets)), last],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset",
                 "ids_crc32" if digest else "ids"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = encode(text.as_py() or "")
                ids = np.append(found, np.uint32(end)).astype(np.uint32, copy=False)
                packer.add(doc.as_py(), ids)
                if len(packer.done) >= _EMIT:
                    yield emit(kind)
        packer.finish()
        if packer.done:
            yield emit(kind)

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END,
         max_open: int = MAX_OPEN, digest: bool = False, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset) and the piece's ids, or their CRC-32."""
    vocabulary = Path(path or vocabulary_path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(
        _pack_task(vocabulary, length, end, max_open, digest),
        f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
        f"offset bigint, " + ("ids_crc32 bigint" if digest else "ids array<int>"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), digest=True)


QUERIES = {"op12_packing": op12_packing}
ORACLE: dict[str, str] = {}
