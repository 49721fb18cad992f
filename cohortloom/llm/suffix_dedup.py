"""Removal of passages that occur elsewhere, byte for byte.

A byte goes if some string of ``length`` bytes that covers it also starts
anywhere else in the corpus, the same text included.

1. Anchors.  Among the ``gram``-byte strings of every window of ``length`` bytes the
   one with the least hash (the last of equal ones) is the window's anchor.  It
   depends on the window's bytes alone, so equal windows have equal anchors at
   equal offsets.  Every window has one anchor; an anchor stands for a run of
   neighbouring windows, of which only a digest travels.  In a periodic text equal
   runs follow each other; they make one row with their number.
2. Classes.  Anchor hashes that occur once are dropped.  Runs with equal digests
   are one class: in a class of two or more all bytes repeat.  Copies of any
   number are thus settled by counting, combined before the shuffle.
3. Cells.  Classes that share an anchor hash but differ are compared.  Windows are
   grouped by offset into cells of ``cell`` windows; all windows of a cell share a
   core of ``length - cell + 1`` bytes, and cells with equal cores are compared.
4. Each group of cells is written as ``left bytes, core, right bytes`` with the core
   as one symbol, and all strings of ``cell`` symbols that start twice are found by
   threshold-bounded interval expansion on the Burrows-Wheeler transform of the
   batch (``bwt.repeated_starts``).  Such a string holds the core, so it is a window.
   Groups of more than ``max_group`` classes are compared by one digest a window
   instead, spread over the cluster.
5. Covered windows of a class give spans in all its members; spans of a document
   are merged and cut out.

``repeats_and_passages`` also tells shorter passages.  Spans of the shorter strings
are found first, over everything; a longer string that repeats lies inside a merged
one with all its occurrences, so only those spans go through the steps again.

Hashes decide what is compared and which whole runs are equal (64-bit anchor and
64-bit digest together); the strings compared in step 4 are the bytes themselves,
next to cores equal by digest.

Defined results: null texts count as empty; texts shorter than ``length`` lose
nothing; rows that repeat an id with its text count as other occurrences of each
other; a very long text is worked in pieces and never cut; null ids are ids like
any other; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.bwt import repeated_starts
from cohortloom.llm.common import discard, documents, slices, stored

LENGTH = 400
GRAM = 128
CELL = 68
MAX_GROUP = 4_000
PIECE = 1 << 18          # bytes worked at once
BATCH = 250_000          # symbols of one transform, beyond its first group
PASSAGE_LENGTH = 200     # 51 words of three letters and their blanks take 203 bytes
PASSAGE_GRAM = 64
PASSAGE_WORDS = 51

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done:done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return out


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, have = a, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class _Hasher:
    """Polynomial hashes of fixed-length strings modulo 2^64, mixed."""

    def __init__(self, gram: int, size: int):
        rng = np.random.default_rng(20240229)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.gram = gram
        self.up = _powers(_BASE, size)
        self.down = _powers(pow(_BASE, -1, 1 << 64), size)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[raw] * self.up[:n], out=sums[1:])
        h = (sums[self.gram:] - sums[:-self.gram]) * self.down[:n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def _runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: _Hasher, length: int):
    """(hash, anchor, first window, last window) of all windows inside [start, end) pieces."""
    h = hasher(raw)
    n_windows = len(raw) - length + 1
    width = length - hasher.gram + 1
    place = np.uint64((1 << 22) - 1)
    # High bits of the hash, then the place counted from the end: ties take the last.
    key = (h & ~place) | (place - np.arange(len(h), dtype=np.uint64))
    owner = (place - (_least(key, width) & place)).astype(np.int64)[:n_windows]
    valid = np.zeros(n_windows + 1, np.int32)
    np.add.at(valid, starts, 1)
    np.add.at(valid, ends - length + 1, -1)
    owner[np.cumsum(valid[:-1]) == 0] = -1
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.append(cut[1:] - 1, n_windows - 1)
    keep = owner[cut] >= 0
    at = owner[cut[keep]]
    return h[at], at, cut[keep], last[keep]


def _fold(h: np.ndarray, d: np.ndarray, rows: np.ndarray, pos: np.ndarray, lo: np.ndarray,
          hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of equal runs that follow each other without a gap in one text."""
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(h), bool)
    new[1:] = pos[1:] != (pos + hi - lo + 1)[:-1]
    for column in (h, d, rows, lo, hi):
        new[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(h)))


def _pieces(texts: Iterable[bytes], length: int, within: list | None = None
            ) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (row, offset, bytes); long texts in pieces that overlap by a window less one.

    ``within`` holds the spans of each text to be worked, instead of all of it.
    """
    block, held = [], 0
    for row, text in enumerate(texts):
        for start, end in [(0, len(text))] if within is None else within[row]:
            for at in range(start, end - length + 1, PIECE):
                part = text[at:min(at + PIECE + length - 1, end)]
                block.append((row, at, part))
                held += len(part)
                if held >= PIECE:
                    yield block
                    block, held = [], 0
    if block:
        yield block


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _digest(data: bytes, *salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=b"".join(
        x.to_bytes(2, "little") for x in salt)).digest(), "little", signed=True)


def _anchor_task(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(gram, 2 * PIECE + 2 * length)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            uid, chk = batch.column(0), batch.column(1)
            within = None
            if batch.num_columns == 4:
                texts = (unpack(t.as_buffer()) for t in batch.column(2))
                within = [[(s["start"], s["end"]) for s in spans]
                          for spans in batch.column(3).to_pylist()]
            else:
                texts = (t.as_buffer().to_pybytes() for t in batch.column(2))
            for block in _pieces(texts, length, within):
                joined = b"".join(part for _, _, part in block)
                raw = np.frombuffer(joined, np.uint8)
                ends = np.cumsum([len(part) for _, _, part in block])
                starts = ends - [len(part) for _, _, part in block]
                h, at, first, last = _runs(raw, starts, ends, hasher, length)
                piece = np.searchsorted(ends, first, side="right")
                lo, hi = at - last, at - first
                d = [_digest(joined[a:b + length], x, y) for a, b, x, y in zip(
                    first.tolist(), last.tolist(), lo.tolist(), hi.tolist())]
                rows = np.array([row for row, _, _ in block])[piece]
                shift = np.array([o for _, o, _ in block])[piece] - starts[piece]
                keep, times = _fold(h, np.array(d, np.int64), rows, at + shift, lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [_signed(h[keep]), pa.array(np.array(d, np.int64)[keep]),
                     uid.take(pa.array(rows[keep])), chk.take(pa.array(rows[keep])),
                     pa.array((at + shift)[keep], pa.int64()), pa.array(times, pa.int64()),
                     pa.array(lo[keep], pa.int16()), pa.array(hi[keep], pa.int16())],
                    ["h", "d", "uid", "chk", "pos", "times", "lo", "hi"])

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, which halves what is shuffled."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([pack(t.as_buffer()) for t in batch.column(
                batch.num_columns - 1)], pa.binary())], batch.schema.names)


def squeezed(rows: DataFrame) -> DataFrame:
    """The last column, binary, compressed."""
    return rows.mapInArrow(_squeeze, rows.schema)


def anchors(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row for each anchor: hash, digest of its windows, place, and window offsets.

    With a fourth column, spans, the texts are compressed and only windows inside count.
    ``times`` equal anchors that follow each other, ``hi - lo + 1`` bytes apart, are one row.
    """
    return rows.mapInArrow(
        _anchor_task(length, gram), "h bigint, d bigint, uid bigint, chk int, pos bigint, "
        "times bigint, lo smallint, hi smallint")


CELL_COLUMNS = ("h", "d", "single", "cell", "core", "lo", "left", "right")
CELL_SCHEMA = ("h bigint, d bigint, single boolean, cell smallint, core bigint, lo smallint, "
               "left binary, right binary")
CELL_KEY = ["h", "cell", "core"]


def _cell_task(length: int, cell: int):
    """Cells of the classes' first members, read from their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "body"):
            out = {c: [] for c in CELL_COLUMNS}
            for packed, places in zip(batch.column("body"), batch.column("places").to_pylist()):
                text = unpack(packed.as_py())
                for p in places:
                    pos = p["pos"]
                    for i in range(p["lo"] // cell, p["hi"] // cell + 1):
                        a, b = max(p["lo"], i * cell), min(p["hi"], (i + 1) * cell - 1)
                        begin, end = pos - i * cell, pos - (i + 1) * cell + 1 + length
                        out["h"].append(p["h"])
                        out["d"].append(p["d"])
                        out["single"].append(p["n"] == 1)
                        out["cell"].append(i)
                        out["core"].append(_digest(text[begin:end]))
                        out["lo"].append(a)
                        out["left"].append(text[pos - b:begin])
                        out["right"].append(text[end:pos - a + length])
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int16(), pa.int64(), pa.int16(),
                     pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return run


def _search(groups: list[list[tuple]], cell: int) -> list[tuple[int, int, int, int]]:
    """(h, d, lo, hi): offsets of windows that start in two members of a group.

    A member is (h, d, cell, left, right, single).  Symbols: 0 ends the text, then one
    separator for each member, the bytes, and one core for each group.
    """
    members = [m for g in groups for m in g]
    n = len(members)
    base, parts, begins, at = n + 1, [], [], 0
    k = 0
    for g, group in enumerate(groups):
        core = np.array([base + 256 + g], np.int32)
        for _, _, _, left, right, _ in group:
            part = np.concatenate([np.frombuffer(left, np.uint8).astype(np.int32) + base, core,
                                   np.frombuffer(right, np.uint8).astype(np.int32) + base,
                                   np.array([k + 1], np.int32)])
            parts.append(part)
            begins.append(at)
            at += len(part)
            k += 1
    text = np.concatenate([*parts, np.zeros(1, np.int32)])
    found = repeated_starts(text, cell)
    which = np.searchsorted(np.array(begins), found, side="right") - 1
    out: list[tuple[int, int, int, int]] = []
    before = None
    for p, m in zip(found.tolist(), which.tolist()):
        h, d, i, left, _, single = members[m]
        if single:  # classes of several members are covered as a whole
            at = i * cell + len(left) - (p - begins[m])
            if before == (m, p - 1):
                out[-1] = (h, d, at, out[-1][3])
            else:
                out.append((h, d, at, at))
            before = (m, p)
    return out


RANGE_SCHEMA = "h bigint, d bigint, lo smallint, hi smallint"


def _search_task(cell: int):
    """Rows arrive sorted by cell key and class; groups are batched into one transform."""
    def emit(groups: list) -> pa.RecordBatch:
        got = list(zip(*_search(groups, cell))) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int16(), pa.int16()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(got, kinds)],
                                          ["h", "d", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, group, key, size, mine = [], [], None, 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist()
                       for c in ("h", "cell", "core", "d", "left", "right", "single")]
            for h, i, core, d, left, right, single in zip(*columns):
                if (h, i, core) != key:
                    if len(group) > 1:
                        if groups and size + mine > BATCH:
                            yield emit(groups)
                            groups, size = [], 0
                        groups.append(group)
                        size += mine
                    group, key, mine = [], (h, i, core), 0
                if not group or group[-1][1] != d:  # equal rows bring a class twice
                    group.append((h, d, i, left, right, single))
                    mine += len(left) + len(right) + 2
        if len(group) > 1:
            if groups and size + mine > BATCH:
                yield emit(groups)
                groups = []
            groups.append(group)
        if groups:
            yield emit(groups)

    return run


def _by_window(cells: DataFrame, cell: int) -> DataFrame:
    """Windows met twice, by one digest a window: for groups too large for one task."""
    # A window of offset o takes o - cell * i bytes of the left and the rest of the right.
    n_left = F.col("at") - F.col("cell") * cell
    each = cells.dropDuplicates([*CELL_KEY, "d"]).withColumn("at", F.explode(F.sequence(
        F.col("lo").cast("int"), (F.col("cell") * cell + F.length("left")).cast("int"))))
    digest = F.xxhash64(F.expr(f"substring(left, cast(length(left) - (at - cell * {cell}) + 1 as int), "
                               f"cast(at - cell * {cell} as int))"),
                        F.expr(f"substring(right, 1, cast({cell} - 1 - (at - cell * {cell}) as int))"),
                        n_left)
    each = each.select(*CELL_KEY, "d", "single", "at", digest.alias("w"))
    twice = each.groupBy(*CELL_KEY, "at", "w").agg(F.count("*").alias("n")).filter("n > 1")
    at = F.col("at").cast("smallint")
    return (each.filter("single").join(twice, [*CELL_KEY, "at", "w"])
            .select("h", "d", at.alias("lo"), at.alias("hi")))


def covered_ranges(runs: DataFrame, texts: DataFrame, length: int = LENGTH, cell: int = CELL,
                   max_group: int = MAX_GROUP) -> DataFrame:
    """(h, d, lo, hi): offsets of covered windows in every member of a class.

    ``runs`` are the anchors whose hash occurs at least twice.
    """
    classes = stored(runs.groupBy("h", "d").agg(
        F.sum("times").alias("n"), F.min(F.struct("uid", "chk", "pos", "lo", "hi")).alias("m")))
    n_classes = classes.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    most = n_classes.agg(F.max("k")).first()[0] or 0
    places = classes.join(n_classes, "h").groupBy("m.uid", "m.chk").agg(F.collect_list(F.struct(
        "h", "d", "n", "m.pos", "m.lo", "m.hi")).alias("places"))
    cells = texts.join(places, ["uid", "chk"]).select("body", "places").mapInArrow(
        _cell_task(length, cell), CELL_SCHEMA)
    whole = classes.filter("n > 1").select("h", "d", "m.lo", "m.hi")
    small = cells
    if most > max_group:
        cells = stored(cells)
        large = n_classes.filter(F.col("k") > max_group).select("h")
        small = cells.join(large, "h", "left_anti")
        whole = whole.unionByName(_by_window(cells.join(large, "h", "left_semi"), cell))
    return whole.unionByName(
        small.repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY, "d")
        .mapInArrow(_search_task(cell), RANGE_SCHEMA))


def _merge(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = "array<struct<start: bigint, end: bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _part_task(length: int, min_words: int):
    """Passages of enough words, and the merged spans that a string of ``length`` fits into.

    Texts without such a span are done: their body is replaced by their digest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "body"):
            out = {c: [] for c in ("n_bytes", "passages", "within", "kept_sha256", "body")}
            for packed, found in zip(batch.column("body"), batch.column("spans").to_pylist()):
                text = unpack(packed.as_buffer())
                spans = [{"start": a, "end": b}
                         for a, b in _merge([(s["start"], s["end"]) for s in found or ()])]
                within = [s for s in spans if s["end"] - s["start"] >= length]
                out["n_bytes"].append(len(text))
                out["passages"].append([s for s in spans if len(
                    text[s["start"]:s["end"]].split()) >= min_words])
                out["within"].append(within)
                out["kept_sha256"].append(None if within else hashlib.sha256(text).hexdigest())
                out["body"].append(packed.as_py() if within else None)
            kinds = [pa.int64(), _SPANS, _SPANS, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], *(pa.array(v, k) for v, k in zip(out.values(), kinds))],
                [*batch.schema.names[:-2], *out])

    return run


def _cut_task(keep_text: bool, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "body"):
            out = {c: [] for c in ("n_bytes", "n_removed", "spans", "kept")}
            for packed, found in zip(batch.column("body"), batch.column("spans").to_pylist()):
                text = unpack(packed.as_py())
                spans = [(a, b) for a, b in _merge([(s["start"], s["end"]) for s in found or ()])
                         if not min_words or len(text[a:b].split()) >= min_words]
                edges = [0, *(x for span in spans for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                # Characters that lose some of their bytes go whole.
                out["kept"].append(kept.decode("utf-8", "ignore") if keep_text
                                   else hashlib.sha256(kept).hexdigest())
            kinds = [pa.int64(), pa.int64(), _SPANS, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], *(pa.array(v, k) for v, k in zip(out.values(), kinds))],
                [*batch.schema.names[:-2], "n_bytes", "n_removed", "spans",
                 "kept_text" if keep_text else "kept_sha256"])

    return run


def _spans(found: DataFrame, texts: DataFrame, length: int, cell: int, max_group: int
           ) -> DataFrame:
    """(uid, chk, spans) of the texts that hold covered bytes, from all their anchors."""
    found = stored(found)
    twice = found.groupBy("h").agg(F.sum("times").alias("k")).filter("k > 1").select("h")
    runs = stored(found.join(twice, "h"))
    discard(found)
    ranges = covered_ranges(runs, texts, length, cell, max_group)
    # The spans of runs that follow each other overlap.
    ahead = (F.col("times") - 1) * (F.col("run_hi") - F.col("run_lo") + 1)
    return (runs.withColumnsRenamed({"lo": "run_lo", "hi": "run_hi"}).join(ranges, ["h", "d"])
            .groupBy("uid", "chk").agg(F.collect_set(F.struct(
                (F.col("pos") - F.col("hi")).alias("start"),
                (F.col("pos") + ahead - F.col("lo") + length).alias("end"))).alias("spans")))


def _rows(docs: DataFrame, doc_id: str, text: str, *also: str) -> tuple[list[str], DataFrame]:
    """The other columns, and rows of them, a key of id and text, and the text's bytes."""
    made = ("uid", "chk", "body", "spans", "n_bytes", "n_removed", "kept_text", "kept_sha256",
            *also)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c != text and c not in made]
    return rest, docs.select(*rest, F.xxhash64(F.col(doc_id), body).alias("uid"), F.hash(
        body, F.col(doc_id)).alias("chk"), body.cast("binary").alias("body"))


def _schema(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def repeats(docs: DataFrame, keep_text: bool = False, length: int = LENGTH, gram: int = GRAM,
            cell: int = CELL, max_group: int = MAX_GROUP, doc_id: str = "doc_id",
            text: str = "text", min_words: int = 0) -> DataFrame:
    """The columns of ``docs`` but its text, then ``n_bytes n_removed spans`` and the kept text
    or its digest.  Columns of these names are replaced.  Spans of fewer than ``min_words``
    words stay."""
    rest, rows = _rows(docs, doc_id, text)
    whole = rows.select("uid", "chk", "body")
    spans = _spans(anchors(whole, length, gram), squeezed(whole), length, cell, max_group)
    both = squeezed(rows).join(spans, ["uid", "chk"], "left").select(*rest, "body", "spans")
    return both.mapInArrow(_cut_task(keep_text, min_words), _schema(docs, rest) + (
        f"n_bytes bigint, n_removed bigint, spans {SPANS}, "
        + ("kept_text string" if keep_text else "kept_sha256 string")))


def repeats_and_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                         cell: int = CELL, max_group: int = MAX_GROUP, doc_id: str = "doc_id",
                         text: str = "text", passage_length: int = PASSAGE_LENGTH,
                         passage_gram: int = PASSAGE_GRAM, min_words: int = PASSAGE_WORDS
                         ) -> DataFrame:
    """``repeats`` and a column ``passages``: spans of at least ``min_words`` words that strings
    of ``passage_length`` bytes cover, which is at most ``length``.

    ``n_removed``, ``spans`` and the digest are those of ``length`` alone.
    """
    if passage_length > length:
        raise ValueError("passage_length must not exceed length")
    rest, rows = _rows(docs, doc_id, text, "passages", "within")
    whole, key = rows.select("uid", "chk", "body"), ["uid", "chk"]
    spans = _spans(anchors(whole, passage_length, passage_gram), squeezed(whole), passage_length,
                   cell, max_group)
    both = squeezed(rows).join(spans, key, "left").select(*rest, *key, "body", "spans")
    parts = stored(both.mapInArrow(_part_task(length, min_words), _schema(both, [*rest, *key]) + (
        f"n_bytes bigint, passages {SPANS}, within {SPANS}, kept_sha256 string, body binary")))
    left = parts.filter("body is not null")
    spans = _spans(anchors(left.select(*key, "body", "within"), length, gram),
                   left.select(*key, "body"), length, cell, max_group)
    both = left.join(spans, key, "left").select(*rest, "passages", "body", "spans")
    cut = both.mapInArrow(_cut_task(False, 0), _schema(both, [*rest, "passages"]) + (
        f"n_bytes bigint, n_removed bigint, spans {SPANS}, kept_sha256 string"))
    done = parts.filter("body is null").select(
        *rest, "passages", "n_bytes", F.lit(0).cast("long").alias("n_removed"),
        F.array().cast(SPANS).alias("spans"), "kept_sha256")
    return done.unionByName(cut)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the passages of over 50 words that shorter strings tell."""
    found = repeats_and_passages(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256", F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        .alias("passage_bytes"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE: dict[str, str] = {}
