"""Softmax boosting over the binned matrix: one multiclass ensemble for each fold, grown together.

A round fits one regression tree for each class to the gradients of the softmax loss, on columns
drawn once a tree.  A person trains the models of all folds but the own one.

A matrix of up to ``HELD`` bytes is held by one task for each model, which grows all rounds of
it; models don't depend on each other and run side by side.  Only trees reach the driver.

In a larger matrix the trees of all classes and folds grow level by level: a job sums gradients
by node, feature and bin in every task, adds the sums up by (model, class, node, block of
features), and finds each block's best split where the sums meet; only best splits reach the
driver.  Margins of all models are a column of the stored matrix, written anew every
``keep_every`` rounds; in between tasks add the latest trees themselves.  So a lost task reads its
input again and nothing more, and lineage never grows.

Gradients are rounded to 2 ** -20 and summed as whole numbers, hence sums, splits and results
don't depend on partitions or their order.

The ensemble is a table of nodes, ``(model, tree, klass, node, feature_key, threshold, left,
right, value)``; a value up to the threshold goes left, an absent one counts as zero.  Nodes are
numbered as in a heap, so that a leaf's number tells its path.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.config import PhenotypeConfig
from cohortloom.functions.distributed import discard, stored, union_all
from cohortloom.operators import binning
from cohortloom.operators.assemble import label3

# Tasks get this module's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ONE = 1 << 20                # a gradient of 1
CELLS = 32 << 20             # bytes of the dense matrix of a task
BLOCK_BINS = 1 << 16         # bins of a block of features
ROWS = 1_000_000             # rows that a model's task may hold
PART = 100_000               # rows of a partition of a matrix that no task holds
PIECE = 10_000               # rows of a partition of one that a task holds
HELD = 400 << 20             # bytes that a model's task may hold
WHOLE = 0                    # the model that everybody trains


@dataclass(frozen=True)
class Boost:
    """Settings of an ensemble; ``of`` takes them from a study."""

    rounds: int = PhenotypeConfig.trees
    learning_rate: float = PhenotypeConfig.learning_rate
    depth: int = PhenotypeConfig.tree_depth
    column_sample: float = PhenotypeConfig.column_sample
    seed: int = PhenotypeConfig.seed
    classes: int = 3
    l2: float = 1.0
    min_child: float = 1.0
    min_gain: float = 1e-6
    keep_every: int = 10

    @classmethod
    def of(cls, cfg: PhenotypeConfig) -> Boost:
        return cls(cfg.trees, cfg.learning_rate, cfg.tree_depth, cfg.column_sample, cfg.seed)


class Tree:
    """Nodes by heap number; ``feature`` is -1 in a leaf."""

    def __init__(self, depth: int):
        self.feature = np.full(2 << depth, -1, np.int32)
        self.bin = np.zeros(2 << depth, np.int16)
        self.value = np.zeros(2 << depth)
        self.open = {1}              # nodes of the deepest level that may be split

    def place(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row of bins."""
        node, rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(depth if x.shape[1] else 0):
            feature = self.feature[node]
            right = x[rows, np.maximum(feature, 0)] > self.bin[node]
            node = np.where(feature >= 0, 2 * node + right, node)
        return node


@dataclass(frozen=True)
class Layout:
    """What tasks know of the features: one small entry a feature."""

    offsets: np.ndarray          # first bin of each feature, and the number of bins
    zero: np.ndarray             # bin of an absent value
    present: np.ndarray          # model x feature
    models: tuple[int, ...]

    @property
    def n_features(self) -> int:
        return len(self.zero)

    def blocks(self) -> np.ndarray:
        """The block of each feature, numbered without gaps."""
        return np.unique(self.offsets[:-1] // BLOCK_BINS, return_inverse=True)[1]

    def sampled(self, boost: Boost, tree: int, model: int, klass: int) -> np.ndarray:
        """The columns drawn for a tree."""
        have = np.flatnonzero(self.present[model])
        rng = np.random.default_rng([boost.seed, tree, self.models[model], klass])
        n = max(1, int(boost.column_sample * len(have)))
        out = np.zeros(self.n_features, bool)
        out[rng.permutation(have)[:n]] = True
        return out


def _matrix(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[tuple]:
    """(batch, folds, classes, dense bins, margins, row of each entry, entries' bins)."""
    each = max(1, CELLS // max(layout.n_features, 1))
    for whole in batches:
        for at in range(0, whole.num_rows, each):
            batch = whole.slice(at, each)
            n = batch.num_rows
            lists, found = batch.column("slots"), batch.column("bins")
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(n), size)
            slot = lists.flatten().to_numpy(zero_copy_only=False)
            bin_ = found.flatten().to_numpy(zero_copy_only=False)
            x = np.repeat(layout.zero[None, :], n, axis=0)
            x[row, slot] = bin_
            margins = batch.column("margins").flatten().to_numpy(zero_copy_only=False)
            yield (batch, batch.column("fold").to_numpy(zero_copy_only=False),
                   batch.column("y").to_numpy(zero_copy_only=False), x,
                   margins.reshape(n, len(layout.models), -1).copy(), row, layout.offsets[slot] + bin_)


def _advance(margins: np.ndarray, x: np.ndarray, trees: list[dict], depth: int) -> None:
    for grown in trees:
        for (m, c), tree in grown.items():
            margins[:, m, c] += tree.value[tree.place(x, depth)]


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _gradients(p: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of a class as whole numbers; a hessian is at least 1."""
    return np.rint((p - own) * ONE), np.rint(np.maximum(2 * p * (1 - p), 1 / ONE) * ONE)


SUM_SCHEMA = "model int, klass int, node int, block int, bins binary, g binary, h binary, loss double"
SUM_KEY = ["model", "klass", "node", "block"]


def _sum_task(batches: Iterator[pa.RecordBatch], layout: Layout, boost: Boost, latest: list[dict],
              grown: dict, level: int) -> Iterator[pa.RecordBatch]:
    """Gradient sums of a task's rows by open node and bin; bin -1 is the node's total."""
    n_bins = int(layout.offsets[-1])
    sums, loss = {}, np.zeros(len(layout.models))
    for _, fold, y, x, margins, row, entry in _matrix(batches, layout):
        _advance(margins, x, latest, boost.depth)
        p = _softmax(margins)
        for m, model in enumerate(layout.models):
            mine = np.ones(len(y), bool) if model == WHOLE else fold != model
            if not level:
                loss[m] -= np.log(np.maximum(p[mine, m, y[mine]], 1e-300)).sum()
            for c in range(boost.classes):
                tree = grown[m, c]
                if not tree.open:
                    continue
                nodes = sorted(tree.open)
                number = np.full(len(tree.feature), -1)
                number[nodes] = np.arange(len(nodes))
                at = np.where(mine, number[tree.place(x, level)], -1)
                q = p[:, m, c]
                g, h = _gradients(q, y == c)
                if (m, c) not in sums:
                    sums[m, c] = np.zeros((2, len(nodes), n_bins + 1))
                total, held = sums[m, c], at >= 0
                for k, weight in enumerate((g, h)):
                    total[k, :, n_bins] += np.bincount(at[held], weight[held], len(nodes))
                keep = at[row] >= 0
                place = at[row[keep]] * (n_bins + 1) + entry[keep]
                for k, weight in enumerate((g, h)):
                    total[k] += np.bincount(place, weight[row[keep]], total[k].size).reshape(total[k].shape)
    out: list[tuple] = []
    edge = np.flatnonzero(np.diff(layout.blocks(), prepend=-1)) if layout.n_features else np.array([0])
    first = np.append(layout.offsets[edge], n_bins).astype(np.int64)
    for (m, c), total in sums.items():
        for k, node in enumerate(sorted(grown[m, c].open)):
            if not total[1, k, n_bins]:         # every row has a hessian, so nobody is here
                continue
            for b, (lo, hi) in enumerate(zip(first, first[1:])):
                met = np.flatnonzero(total[1, k, lo:hi]) + lo
                bins = np.append(met, -1).astype("<i4")
                out.append((m, c, node, b, bins.tobytes(), total[0, k, bins].tobytes(),
                            total[1, k, bins].tobytes(), 0.0))
    if not level:
        out.extend((m, -1, 0, -1, b"", b"", b"", float(x)) for m, x in enumerate(loss))
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3 + [pa.float64()]
    columns = list(zip(*out)) or [()] * 8
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, kind) for x, kind in zip(columns, kinds)],
        [*SUM_KEY, "bins", "g", "h", "loss"])


SPLIT_SCHEMA = ("model int, klass int, node int, feature int, bin int, gain double, "
                "gl double, hl double, g double, h double")


def best_split(g: np.ndarray, h: np.ndarray, total_g: float, total_h: float, layout: Layout,
               features: np.ndarray, boost: Boost) -> tuple[int, int, float, float, float]:
    """(feature, bin, gain, left gradient, left hessian) over some features, -1 for none.

    ``g`` and ``h`` are sums by bin without the bins of absent values, which get the rest.
    The first of equal gains is taken.
    """
    start, end = layout.offsets[features], layout.offsets[features + 1]
    base, last = int(start[0]), int(end[-1])
    g, h = g[base:last].copy(), h[base:last].copy()
    start, end = start - base, end - base
    zero = start + layout.zero[features]
    g[zero] += total_g - np.add.reduceat(g, start)
    h[zero] += total_h - np.add.reduceat(h, start)
    own = np.repeat(np.arange(len(features)), end - start)
    gl, hl = np.cumsum(g), np.cumsum(h)
    gl, hl = gl - (gl[start] - g[start])[own], hl - (hl[start] - h[start])[own]
    gr, hr = total_g - gl, total_h - hl
    gl, hl, gr, hr, all_g, all_h = (v / ONE for v in (gl, hl, gr, hr, total_g, total_h))
    gain = gl * gl / (hl + boost.l2) + gr * gr / (hr + boost.l2) - all_g * all_g / (all_h + boost.l2)
    gain[(hl < boost.min_child) | (hr < boost.min_child)] = -1.0
    gain[end - 1] = -1.0
    at = int(np.argmax(gain))
    if gain[at] <= boost.min_gain:
        return -1, 0, 0.0, 0.0, 0.0
    return int(features[own[at]]), at - int(start[own[at]]), float(gain[at]), float(gl[at]), float(hl[at])


def _split_task(batches: Iterator[pa.RecordBatch], layout: Layout, boost: Boost, tree: int
                ) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key; each key's sums are added up and searched."""
    n_bins, block_of = int(layout.offsets[-1]), layout.blocks()
    key, g, h = None, np.zeros(n_bins + 1), np.zeros(n_bins + 1)
    drawn: dict = {}
    loss: dict[int, float] = {}
    out: list[tuple] = []

    def close() -> None:
        m, c, node, block = key
        if (m, c) not in drawn:
            drawn[m, c] = layout.sampled(boost, tree, m, c)
        some = np.flatnonzero(block_of == block)       # without a gap, so that bins are, too
        total_g, total_h = g[-1], h[-1]
        found = (-1, 0, 0.0, 0.0, 0.0)
        if len(some):
            picked = drawn[m, c][some]
            if picked.any():
                found = _best_of(g, h, total_g, total_h, layout, some, picked, boost)
        out.append((m, c, node, *found, total_g / ONE, total_h / ONE))

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in SUM_KEY))
        for r, k in enumerate(keys):
            if k[3] < 0:
                loss[k[0]] = loss.get(k[0], 0.0) + batch.column("loss")[r].as_py()
                continue
            if k != key:
                if key is not None:
                    close()
                key, g[:], h[:] = k, 0.0, 0.0
            bins = np.frombuffer(batch.column("bins")[r].as_buffer(), "<i4")
            g[bins] += np.frombuffer(batch.column("g")[r].as_buffer(), "<f8")
            h[bins] += np.frombuffer(batch.column("h")[r].as_buffer(), "<f8")
    if key is not None:
        close()
    out.extend((m, -1, 0, -1, 0, x, 0.0, 0.0, 0.0, 0.0) for m, x in loss.items())
    kinds = [pa.int32()] * 5 + [pa.float64()] * 5
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, kind) for x, kind in zip(list(zip(*out)) or [()] * 10, kinds)],
        ["model", "klass", "node", "feature", "bin", "gain", "gl", "hl", "g", "h"])


def _best_of(g, h, total_g, total_h, layout: Layout, some: np.ndarray, picked: np.ndarray,
             boost: Boost):
    """The best split of a block; bins of columns that were not drawn count as never met."""
    lo, hi = layout.offsets[some[0]], layout.offsets[some[-1] + 1]
    drop = np.repeat(~picked, np.diff(layout.offsets[some[0]:some[-1] + 2]))
    gb, hb = g.copy(), h.copy()
    gb[lo:hi][drop] = 0.0
    hb[lo:hi][drop] = 0.0
    return best_split(gb, hb, total_g, total_h, layout, some, boost)


def _keep_task(batches: Iterator[pa.RecordBatch], layout: Layout, boost: Boost, latest: list[dict]
               ) -> Iterator[pa.RecordBatch]:
    """The matrix with margins that hold the latest trees."""
    for batch, _, _, x, margins, _, _ in _matrix(batches, layout):
        _advance(margins, x, latest, boost.depth)
        ends = np.arange(len(x) + 1, dtype=np.int32) * margins[0].size
        held = pa.ListArray.from_arrays(pa.array(ends), pa.array(margins.ravel()))
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays(
            [held if c == "margins" else batch.column(c) for c in names], names)


@dataclass
class Ensemble:
    """A fitted ensemble: nodes, out-of-fold margins, and the loss before every round."""

    nodes: DataFrame
    matrix: DataFrame
    slots: DataFrame
    models: tuple[int, ...]
    boost: Boost
    loss: list[tuple[int, int, float]] = field(default_factory=list)

    def predictions(self) -> DataFrame:
        """(person_id, fold, y3, p0..): from the model that did not see the person.

        With the one model of everybody, from that model.
        """
        k = self.boost.classes
        place = F.array_position(F.array(*[F.lit(m) for m in self.models]), F.col("fold"))
        at = F.lit(0) if self.models == (WHOLE,) else (place.cast("int") - 1) * k
        own = [F.element_at("margins", (at + c + 1).cast("int")) for c in range(k)]
        return with_softmax(self.matrix.select(
            "person_id", "fold", F.col("y").alias("y3"), *[m.alias(f"m{c}") for c, m in enumerate(own)]), k)

    def loss_table(self, spark: SparkSession) -> DataFrame:
        """(model, round, loss): mean training loss after so many rounds."""
        return spark.createDataFrame(self.loss, "model int, round int, loss double")


def with_softmax(margins: DataFrame, classes: int) -> DataFrame:
    """Columns m0.. replaced by probabilities p0.."""
    names = [f"m{c}" for c in range(classes)]
    top = F.greatest(*names) if classes > 1 else F.col(names[0])
    e = [F.exp(F.col(m) - top) for m in names]
    total = sum(e[1:], e[0])
    return margins.select(*[c for c in margins.columns if c not in names],
                          *[(x / total).alias(f"p{c}") for c, x in enumerate(e)])


def _extend(grown: dict, found: list, boost: Boost, level: int) -> None:
    """Give the open nodes of a level their best splits, or their values."""
    best: dict = {}
    for r in found:
        key = (r["model"], r["klass"], r["node"])
        if r["klass"] >= 0 and (key not in best or (-r["gain"], r["feature"])
                                < (-best[key]["gain"], best[key]["feature"])):
            best[key] = r
    for tree in grown.values():
        tree.open = set()
    for (m, c, node), r in best.items():
        tree = grown[m, c]
        if r["feature"] < 0:
            tree.value[node] = -boost.learning_rate * r["g"] / (r["h"] + boost.l2)
            continue
        tree.feature[node], tree.bin[node] = r["feature"], r["bin"]
        for child, g, h in ((2 * node, r["gl"], r["hl"]),
                            (2 * node + 1, r["g"] - r["gl"], r["h"] - r["hl"])):
            tree.value[child] = -boost.learning_rate * g / (h + boost.l2)
            if level + 1 < boost.depth and h >= 2 * boost.min_child:
                tree.open.add(child)


def _new_trees(layout: Layout, boost: Boost) -> dict:
    return {(m, c): Tree(boost.depth) for m in range(len(layout.models)) for c in range(boost.classes)}


class Held:
    """The rows that train a model: entries by person, and again by feature."""

    def __init__(self, batches: Iterator[pa.RecordBatch], layout: Layout, model: int):
        ys, rows, slots, bins, n = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)], 0
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            mine = np.ones(len(fold), bool) if model == WHOLE else fold != model
            lists = batch.column("slots")
            size = np.diff(lists.offsets.to_numpy())
            keep = np.repeat(mine, size)
            ys.append(batch.column("y").to_numpy(zero_copy_only=False)[mine])
            rows.append(np.repeat(np.arange(n, n + len(ys[-1]), dtype=np.int32), size[mine]))
            slots.append(lists.flatten().to_numpy(zero_copy_only=False)[keep].astype(np.int32))
            bins.append(batch.column("bins").flatten().to_numpy(zero_copy_only=False)[keep].astype(np.uint8))
            n += len(ys[-1])
        self.y = np.concatenate(ys) if ys else np.zeros(0, np.int64)
        self.row, slot, bin_ = np.concatenate(rows), np.concatenate(slots), np.concatenate(bins)
        self.entry = layout.offsets[slot] + bin_
        order = np.argsort(slot, kind="stable")
        self.edge = np.searchsorted(slot[order], np.arange(layout.n_features + 1))
        self.rows_of, self.bins_of = self.row[order], bin_[order]

    def column(self, feature: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and bins of a feature where it is not absent."""
        lo, hi = self.edge[feature], self.edge[feature + 1]
        return self.rows_of[lo:hi], self.bins_of[lo:hi]


def _sides(some: np.ndarray, absent: bool, rows: np.ndarray, right: np.ndarray, scratch: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """Some rows by side: ``rows`` go right where ``right`` says so, all others where ``absent`` does."""
    scratch.fill(absent)
    scratch[rows] = right
    goes = scratch[some]
    return some[~goes], some[goes]


def _grow_tree(held: Held, layout: Layout, boost: Boost, g: np.ndarray, h: np.ndarray, round_: int, m: int,
               c: int) -> tuple[Tree, np.ndarray]:
    """A tree of a model and the leaf of each row.

    Sums are taken over the smaller child only; the other has what is left of its parent, which
    is exact, as sums are whole numbers.
    """
    width, n = int(layout.offsets[-1]) + 1, len(g)
    block_of, drawn = layout.blocks(), layout.sampled(boost, round_, m, c)
    blocks = [(some, drawn[some]) for b in range(int(block_of.max(initial=-1)) + 1)
              for some in [np.flatnonzero(block_of == b)]]
    tree = Tree(boost.depth)
    node, scratch = np.ones(n, np.int32), np.zeros(n, bool)
    members = {1: np.arange(n, dtype=np.int32)}
    weights = (g, h), (g[held.row], h[held.row])

    def add_up(nodes: list[int]) -> dict[int, np.ndarray]:
        number = np.full(len(tree.feature), -1)
        number[nodes] = np.arange(len(nodes))
        at = number[node]
        out = np.zeros((len(nodes), 2, width))
        place = at[held.row]
        keep = np.flatnonzero(place >= 0)
        place = place[keep] * width + held.entry[keep]
        met = np.flatnonzero(at >= 0)
        for k in range(2):
            out[:, k] = np.bincount(place, weights[1][k][keep], len(nodes) * width).reshape(-1, width)
            out[:, k, -1] = np.bincount(at[met], weights[0][k][met], len(nodes))
        return dict(zip(nodes, out))

    sums = add_up([1])
    for level in range(boost.depth):
        found = []
        for k in sorted(tree.open):
            gs, hs = sums[k]
            best = (-1, 0, 0.0, 0.0, 0.0)
            for some, picked in blocks:
                if picked.any():
                    split = _best_of(gs, hs, gs[-1], hs[-1], layout, some, picked, boost)
                    best = split if split[2] > best[2] else best
            found.append(dict(zip(("feature", "bin", "gain", "gl", "hl"), best), model=m, klass=c, node=k,
                              g=gs[-1] / ONE, h=hs[-1] / ONE))
        _extend({(m, c): tree}, found, boost, level)
        split = [r["node"] for r in found if r["feature"] >= 0]
        for k in split:
            feature, bin_ = tree.feature[k], tree.bin[k]
            rows, bins = held.column(feature)
            members[2 * k], members[2 * k + 1] = _sides(
                members.pop(k), layout.zero[feature] > bin_, rows, bins > bin_, scratch)
            node[members[2 * k]], node[members[2 * k + 1]] = 2 * k, 2 * k + 1
        if not tree.open:
            break
        wanted = [k for k in split if {2 * k, 2 * k + 1} & tree.open]
        less = {k: 2 * k + (len(members[2 * k + 1]) < len(members[2 * k])) for k in wanted}
        parents, sums = sums, add_up(list(less.values()))
        for k in wanted:
            other = 4 * k + 1 - less[k]
            if other in tree.open:
                sums[other] = parents[k] - sums[less[k]]
    return tree, node


TREE_SCHEMA = "model int, round int, klass int, loss double, feature binary, bin binary, value binary"


def _model_task(batches: Iterator[pa.RecordBatch], layout: Layout, boost: Boost, m: int
                ) -> Iterator[pa.RecordBatch]:
    """All rounds of a model; the loss before a round stands beside its trees."""
    held = Held(batches, layout, layout.models[m])
    n = len(held.y)
    if not n:
        return
    margins = np.zeros((n, boost.classes))
    for round_ in range(boost.rounds):
        p = _softmax(margins)
        loss, out = float(-np.log(np.maximum(p[np.arange(n), held.y], 1e-300)).sum()), []
        for c in range(boost.classes):
            tree, node = _grow_tree(held, layout, boost, *_gradients(p[:, c], held.y == c), round_, m, c)
            margins[:, c] += tree.value[node]
            out.append((m, round_, c, loss, tree.feature.tobytes(), tree.bin.tobytes(), tree.value.tobytes()))
        kinds = [pa.int32()] * 3 + [pa.float64()] + [pa.binary()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)],
                                         ["model", "round", "klass", "loss", "feature", "bin", "value"])


def _grow_held(table: DataFrame, layout: Layout, boost: Boost) -> tuple[list[dict], list[dict[int, float]]]:
    """The trees of all rounds, and the loss of each model before each.

    A model is a job of one task; the jobs run side by side.
    """
    def one(m: int) -> list:
        return (table.select("fold", "y", "slots", "bins").coalesce(1)
                .mapInArrow(partial(_model_task, layout=layout, boost=boost, m=m), TREE_SCHEMA).collect())

    with ThreadPoolExecutor(len(layout.models)) as pool:
        rows = [r for found in pool.map(one, range(len(layout.models))) for r in found]
    trees, losses = [_new_trees(layout, boost) for _ in range(boost.rounds)], [{} for _ in range(boost.rounds)]
    for r in rows:
        tree = trees[r.round][r.model, r.klass]
        tree.feature, tree.bin = np.frombuffer(r.feature, np.int32), np.frombuffer(r.bin, np.int16)
        tree.value = np.frombuffer(r.value)
        losses[r.round][r.model] = r.loss
    return trees, losses


def _grow(table: DataFrame, layout: Layout, boost: Boost, latest: list[dict], round_: int
          ) -> tuple[dict, dict[int, float]]:
    """The trees of a round, and the loss of each model before it; a level is one job."""
    grown, loss = _new_trees(layout, boost), {}
    for level in range(boost.depth):
        found = (table.mapInArrow(partial(_sum_task, layout=layout, boost=boost, latest=latest,
                                          grown=grown, level=level), SUM_SCHEMA)
                 .repartition(*SUM_KEY).sortWithinPartitions(*SUM_KEY)
                 .mapInArrow(partial(_split_task, layout=layout, boost=boost, tree=round_),
                             SPLIT_SCHEMA).collect())
        for r in found:
            if r.klass < 0:
                loss[r.model] = loss.get(r.model, 0.0) + r.gain
        _extend(grown, found, boost, level)
        if not any(tree.open for tree in grown.values()):
            break
    return grown, loss


def _node_table(spark: SparkSession, trees: list[dict], layout: Layout, slots: DataFrame) -> DataFrame:
    """The ensemble as rows; inner nodes have a feature and a threshold, leaves a value."""
    rows: list[tuple] = []
    for number, grown in enumerate(trees):
        for (m, c), tree in grown.items():
            queue = [1]
            while queue:
                node = queue.pop()
                inner = tree.feature[node] >= 0
                rows.append((layout.models[m], number, c, node,
                             int(tree.feature[node]) if inner else None,
                             int(tree.bin[node]) if inner else None,
                             2 * node if inner else None, 2 * node + 1 if inner else None,
                             None if inner else float(tree.value[node])))
                queue.extend((2 * node, 2 * node + 1) if inner else ())
    plain = spark.createDataFrame(rows, "model int, tree int, klass int, node int, slot int, bin int, "
                                        "left int, right int, value double")
    return plain.join(slots.select("slot", "feature_key", "cuts"), "slot", "left").select(
        "model", "tree", "klass", "node", "feature_key",
        F.get("cuts", F.col("bin")).alias("threshold"), "left", "right", "value")


def fit(members: DataFrame, long: DataFrame, slots: DataFrame, models: tuple[int, ...] = (WHOLE,),
        present: DataFrame | None = None, boost: Boost = Boost(), rows: int = ROWS) -> Ensemble:
    """Ensembles of the given models, grown together over one stored matrix.

    ``members`` has person_id, fold and y (0, 1, ..); model ``k`` learns from folds other than
    ``k``, model 0 from all.  ``present`` gives (slot, present), the columns of each model in
    their order; without it all models take all.  Without features every tree is one leaf.
    """
    spark = members.sparkSession
    shape = slots.orderBy("slot").select("slot", F.size("cuts").alias("n"), "zero").toArrow()
    n_features = shape.num_rows
    offsets = np.concatenate([[0], np.cumsum(shape.column(1).to_numpy())]).astype(np.int64)
    allowed = np.full((len(models), n_features), present is None)
    if present is not None:
        marks = present.toArrow()
        held = np.array(marks.column(1).to_pylist(), bool).reshape(-1, len(models))
        allowed[:, marks.column(0).to_numpy()] = held.T
    layout = Layout(offsets, shape.column(2).to_numpy().astype(np.uint8), allowed, tuple(models))
    start = F.array_repeat(F.lit(0.0), len(models) * boost.classes)
    table = stored(binning.binned_rows(members, long, slots).withColumn("margins", start))
    n = table.groupBy("fold").agg(F.count("*").alias("count"), F.sum(F.size("slots")).alias("entries")).collect()
    total = sum(r["count"] for r in n)
    size = [max(1, sum(r["count"] for r in n if m == WHOLE or r["fold"] != m)) for m in models]
    # Bytes that a task needs for an entry, a person, and a bin of all nodes.
    needs = 40 * sum(r["entries"] for r in n) + 120 * total + (16 << boost.depth) * int(offsets[-1])
    held = total <= rows and needs <= HELD
    parts = max(1, math.ceil(total / (PIECE if held else min(rows, PART))))
    trees, latest, losses = [], [], []

    def keep(table: DataFrame, latest: list[dict]) -> DataFrame:
        new = stored(table.mapInArrow(
            partial(_keep_task, layout=layout, boost=boost, latest=latest), table.schema))
        discard(table)
        return new

    spread = stored(table.repartition(parts, "person_id"))
    discard(table)
    table = spread
    grown_held = _grow_held(table, layout, boost) if held else None
    for round_ in range(boost.rounds):
        grown, loss = ([x[round_] for x in grown_held] if held
                       else _grow(table, layout, boost, latest, round_))
        losses += [(models[m], round_, x / size[m]) for m, x in sorted(loss.items())]
        trees.append(grown)
        latest.append(grown)
        if not held and len(latest) == boost.keep_every or round_ + 1 == boost.rounds:
            table, latest = keep(table, latest), []
    return Ensemble(_node_table(spark, trees, layout, slots), table, slots, layout.models, boost, losses)


def cross_validate(cohort: DataFrame, long: DataFrame, defined: DataFrame | None = None,
                   folds: int = PhenotypeConfig.folds, boost: Boost = Boost(),
                   rows: int = ROWS) -> Ensemble:
    """Models of all folds from one read of the long rows, which carry ``fold``.

    A fold's model takes the features that both its parts hold.  ``defined`` limits them to
    its (fold, feature_key) rows, such as those from cuts of the fold's training part.
    """
    members = cohort.select("person_id", "fold", label3().alias("y"))
    slots = binning.feature_slots(long)
    models = tuple(range(1, folds + 1))
    present = binning.presence(long, slots, folds)
    if defined is not None:
        own = defined.groupBy("feature_key").agg(F.collect_set("fold").alias("own"))
        own = slots.join(own, "feature_key").select("slot", "own")
        both = F.transform("present", lambda p, i: p & F.array_contains(F.col("own"), (i + 1).cast("int")))
        present = present.join(own, "slot").select("slot", both.alias("present"))
    return fit(members, long, slots, models, present, boost, rows)


def train_full(cohort: DataFrame, long: DataFrame, boost: Boost = Boost()) -> Ensemble:
    """One model from everybody."""
    members = cohort.select("person_id", F.col("fold") if "fold" in cohort.columns
                            else F.lit(WHOLE).alias("fold"), label3().alias("y"))
    return fit(members, long, binning.feature_slots(long), boost=boost)


def save(ensemble: Ensemble, path: str) -> None:
    """Write the nodes as Parquet, replacing an older ensemble."""
    ensemble.nodes.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a saved ensemble, for :func:`score`."""
    return spark.read.parquet(path)


# Scoring from the table ------------------------------------------------------------------
class Walk:
    """The trees of an ensemble as arrays; features are numbered as in ``keys``."""

    def __init__(self, nodes: pa.Table):
        have = nodes.column("feature_key").drop_null().unique().to_pylist()
        self.keys: list[str] = sorted(have)
        number = {k: i for i, k in enumerate(self.keys)}
        self.trees: dict = {}
        for row in nodes.select(["model", "tree", "klass", "node", "feature_key", "threshold", "value"]
                                ).sort_by([(c, "ascending") for c in ("model", "tree", "klass")]).to_batches():
            for m, t, c, node, key, threshold, value in zip(*(x.to_pylist() for x in row.columns)):
                self.trees.setdefault((m, t, c), {})[node] = (number.get(key, -1), threshold, value)
        self.models = sorted({m for m, _, _ in self.trees})

    def margins(self, n: int, row: np.ndarray, slot: np.ndarray, value: np.ndarray, classes: int
                ) -> dict[int, np.ndarray]:
        """Margins by model of ``n`` rows with the given entries."""
        order = np.argsort(slot, kind="stable")
        edge = np.searchsorted(slot[order], np.arange(len(self.keys) + 1))
        row, value, scratch = row[order], value[order], np.zeros(n, bool)
        out = {m: np.zeros((n, classes)) for m in self.models}
        for (m, _, c), tree in self.trees.items():
            queue = [(1, np.arange(n, dtype=np.int32))]
            while queue:
                node, some = queue.pop()
                feature, threshold, leaf = tree[node]
                if feature < 0:
                    out[m][some, c] += leaf
                elif len(some):
                    lo, hi = edge[feature], edge[feature + 1]
                    left, right = _sides(some, 0 > threshold, row[lo:hi], value[lo:hi] > threshold, scratch)
                    queue += [(2 * node, left), (2 * node + 1, right)]
        return out


    def leaves(self, tree: dict) -> Iterator[tuple]:
        """(value, {feature: (low, high)}) of each leaf: values in (low, high] lead to it."""
        queue: list[tuple] = [(1, {})]
        while queue:
            node, limits = queue.pop()
            feature, threshold, leaf = tree[node]
            if feature < 0:
                yield leaf, limits
                continue
            low, high = limits.get(feature, (-math.inf, math.inf))
            queue += [(2 * node, limits | {feature: (low, min(high, threshold))}),
                      (2 * node + 1, limits | {feature: (max(low, threshold), high)})]

    def margins_of_repeated(self, n: int, row: np.ndarray, slot: np.ndarray, value: np.ndarray, classes: int
                            ) -> dict[int, np.ndarray]:
        """Margins of rows with several values of a feature, each of which counts.

        A leaf is reached where as many values meet conditions that zero does not meet as there
        are such conditions, and no value fails one that zero meets.
        """
        order = np.argsort(slot, kind="stable")
        edge = np.searchsorted(slot[order], np.arange(len(self.keys) + 1))
        row, value = row[order], value[order]
        out = {m: np.zeros((n, classes)) for m in self.models}
        for (m, _, c), tree in self.trees.items():
            for leaf, limits in self.leaves(tree):
                gained, lost, unmet = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
                for feature, (low, high) in limits.items():
                    some, v = (x[edge[feature]:edge[feature + 1]] for x in (row, value))
                    met = (v > low) & (v <= high)
                    if low < 0 <= high:
                        lost += np.bincount(some[~met], minlength=n)
                    else:
                        gained += np.bincount(some[met], minlength=n)
                        unmet += 1
                out[m][:, c] += np.where((gained == unmet) & (lost == 0), leaf, 0.0)
        return out


def _score_task(batches: Iterator[pa.RecordBatch], walk: Walk, classes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, lists = batch.num_rows, batch.column("e")
        entries = lists.flatten()
        slot, value = (entries.field(k).to_numpy(zero_copy_only=False) for k in ("slot", "value"))
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        found = walk.margins(n, row, slot, value, classes)
        twice = np.zeros(n, bool)
        twice[row[1:][(row[1:] == row[:-1]) & (slot[1:] == slot[:-1])]] = True
        if twice.any():
            own, number = twice[row], np.cumsum(twice) - 1
            again = walk.margins_of_repeated(int(twice.sum()), number[row[own]], slot[own], value[own], classes)
            for m, margins in again.items():
                found[m][twice] = margins
        for m, margins in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, m, np.int32)), batch.column("person_id"), *map(pa.array, margins.T.copy())],
                ["model", "person_id", *[f"m{c}" for c in range(classes)]])


def score(nodes: DataFrame, members: DataFrame, long: DataFrame, classes: int = 3) -> DataFrame:
    """(model, person_id, p0..): every person's values walk down every tree.

    A person's values meet in one row, and tasks take the trees along, whose number follows the
    settings.  Persons with rows that repeat a feature are scored by counting the conditions of
    leaves that their rows meet.
    """
    spark = members.sparkSession
    walk = Walk(nodes.toArrow())
    numbers = spark.createDataFrame(list(enumerate(walk.keys)), "slot int, feature_key string")
    values = long.filter(F.col("person_id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")
                         & (F.col("value") != 0)).join(numbers, "feature_key")
    entry = F.struct("slot", F.col("value").cast("double").alias("value")).alias("e")
    rows = union_all([members.select("person_id", F.lit(True).alias("_member")), values.select("person_id", entry)],
                     allow_missing=True)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grouped = rows.repartition(parts, "person_id").groupBy("person_id").agg(
        F.max("_member").alias("_member"), F.sort_array(F.collect_list("e")).alias("e"))
    kind = members.schema["person_id"].dataType.simpleString()
    margins = ", ".join(f"m{c} double" for c in range(classes))
    return with_softmax(grouped.filter("_member").select("person_id", "e").mapInArrow(
        partial(_score_task, walk=walk, classes=classes), f"model int, person_id {kind}, {margins}"), classes)
