"""Hierarchical navigable small-world graphs over one shard, worked in blocks of queries.

Vectors are unit length, similarity is the inner product.  Layers above the first
hold one node in ``DEGREE`` of the layer below.  Nodes enter the first layer in
batches: a batch searches the graph so far by descent and beam search, takes
diverse near nodes as neighbours, and is linked back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEGREE = 16
BATCH = 512
EXPAND = 4               # nodes of a beam expanded at once


@dataclass
class Graph:
    vectors: np.ndarray          # n x d, float32, unit length
    layers: list[tuple[np.ndarray, np.ndarray]]   # (nodes, neighbours by place), top first
    ground: np.ndarray           # neighbours on the first layer, -1 where none


def _diverse(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` candidates of each row, near ones first, skipping those that are
    nearer to one already taken; gaps are filled with the nearest that were skipped."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    real = np.isfinite(sims)
    v = vectors[np.where(real, ids, 0)]
    between = np.einsum("qad,qbd->qab", v, v, optimize=True)
    taken = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        blocked = (taken & (between[:, c] > sims[:, c:c + 1])).any(axis=1)
        taken[:, c] = real[:, c] & ~blocked & (taken.sum(axis=1) < keep)
    rank = np.where(taken, 0, np.where(real, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    best = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    out = np.where(np.take_along_axis(real, best, 1), np.take_along_axis(ids, best, 1), -1)
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
    return out


def _all_to_all(vectors: np.ndarray, nodes: np.ndarray, keep: int) -> np.ndarray:
    """Neighbours among a small set of nodes, as places in it."""
    sims = vectors[nodes] @ vectors[nodes].T
    np.fill_diagonal(sims, -np.inf)
    k = min(len(nodes), 4 * DEGREE)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return _diverse(np.take_along_axis(sims, near, 1), near, vectors[nodes], keep)


def beam(queries: np.ndarray, vectors: np.ndarray, links: np.ndarray, entry: np.ndarray,
         width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``width`` best nodes found for each query, their similarities, and all nodes seen."""
    q, n = len(queries), len(vectors)
    row = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True                      # stands for no node
    entry = np.where(entry < 0, n, entry)
    first = np.sort(entry, axis=1)
    entry = np.where(np.concatenate([np.zeros((q, 1), bool), first[:, 1:] == first[:, :-1]], 1),
                     n, first)
    seen[row, entry] = True
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])
    sims = np.where(entry < n, np.einsum("qed,qd->qe", padded[entry], queries), -np.inf)
    ids, done = entry, entry >= n
    live = np.arange(q)
    out_ids = np.full((q, width), n)
    out_sims = np.full((q, width), -np.inf)
    while len(live):
        k = min(EXPAND, ids.shape[1])
        open_sims = np.where(done, -np.inf, sims)
        pick = np.argpartition(-open_sims, k - 1, axis=1)[:, :k]
        can = np.isfinite(np.take_along_axis(open_sims, pick, 1))
        over = ~can.any(axis=1)
        if over.any():
            at = live[over]
            m = min(width, ids.shape[1])
            out_ids[at, :m], out_sims[at, :m] = ids[over, :m], sims[over, :m]
            keep = ~over
            live, ids, sims, done = live[keep], ids[keep], sims[keep], done[keep]
            pick, can = pick[keep], can[keep]
            if not len(live):
                break
        np.put_along_axis(done, pick, True, 1)
        nodes = np.where(can, np.take_along_axis(ids, pick, 1), 0)
        near = np.where(can[:, :, None], links[nodes], -1).reshape(len(live), -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        seen[live[:, None], near] = True
        fresh = np.where(near < n, np.einsum("qed,qd->qe", padded[near], queries[live]), -np.inf)
        ids = np.concatenate([ids, near], 1)
        sims = np.concatenate([sims, fresh], 1)
        done = np.concatenate([done, near >= n], 1)
        if ids.shape[1] > width:
            best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            done = np.take_along_axis(done, best, 1)
    return np.where(out_ids < n, out_ids, -1), out_sims, seen


def _descend(graph: Graph, queries: np.ndarray) -> np.ndarray:
    """Entries to the first layer: the best few nodes of the layer above."""
    found = np.zeros((len(queries), 1), np.int64)
    for nodes, links in graph.layers:
        # Entries are nodes of the layer above, which are nodes of this one too.
        place = np.where(found >= 0, np.searchsorted(nodes, np.maximum(found, 0)), -1)
        place = np.where((place >= 0) & (place < len(nodes)), place, 0)
        ids, _, _ = beam(queries, graph.vectors[nodes], links, place, 8)
        found = np.where(ids >= 0, nodes[np.maximum(ids, 0)], -1)
    return found


def _link_back(graph: Graph, sources: np.ndarray, targets: np.ndarray) -> None:
    """Add sources to the neighbours of their targets; full lists keep the nearest half
    and a spread of the others."""
    room = graph.ground.shape[1]
    pair = np.argsort(targets, kind="stable")
    targets, sources = targets[pair], sources[pair]
    nodes, start, count = np.unique(targets, return_index=True, return_counts=True)
    more = np.full((len(nodes), min(count.max(), 4 * room)), -1, np.int64)
    slot = np.arange(len(targets)) - np.repeat(start, count)
    fits = slot < more.shape[1]
    more[np.repeat(np.arange(len(nodes)), count)[fits], slot[fits]] = sources[fits]
    every = np.concatenate([graph.ground[nodes], more], 1)
    sims = np.where(every >= 0, np.einsum(
        "ted,td->te", graph.vectors[np.maximum(every, 0)], graph.vectors[nodes]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    every = np.take_along_axis(every, order, 1)
    size = (every >= 0).sum(axis=1)
    half = room // 2
    # Places half.. of a full list are spread over what is left, so far links survive.
    spread = half + (np.arange(room - half)[None, :] * np.maximum(size - half, 1)[:, None]
                     // (room - half))
    place = np.where(size[:, None] > room,
                     np.concatenate([np.broadcast_to(np.arange(half), (len(nodes), half)), spread], 1),
                     np.arange(room)[None, :])
    graph.ground[nodes] = np.take_along_axis(every, np.minimum(place, every.shape[1] - 1), 1)


def build(vectors: np.ndarray, width: int = 64, seed: int = 11) -> Graph:
    """Graph of unit vectors."""
    n = len(vectors)
    draw = np.random.default_rng(seed).random(n)
    level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(DEGREE)), 6).astype(int)
    graph = Graph(vectors, [], np.full((n, 2 * DEGREE), -1, np.int64))
    for at in range(level.max(initial=0), 0, -1):
        nodes = np.flatnonzero(level >= at)
        if len(nodes) > 1:
            graph.layers.append((nodes, _all_to_all(vectors, nodes, DEGREE)))
    order = np.argsort(-level, kind="stable")
    seed_size = min(n, max(256, int((level > 0).sum())))
    nodes = order[:seed_size]
    if seed_size > 1:
        near = _all_to_all(vectors, nodes, DEGREE)
        graph.ground[nodes, :DEGREE] = np.where(near >= 0, nodes[np.maximum(near, 0)], -1)
        s, t = np.nonzero(near >= 0)
        _link_back(graph, nodes[s], nodes[near[s, t]])
    for at in range(seed_size, n, BATCH):
        batch = order[at:at + BATCH]
        block = vectors[batch]
        entry = _descend(graph, block) if graph.layers else np.broadcast_to(nodes[:8], (len(batch), 8))
        ids, sims, _ = beam(block, vectors, graph.ground, entry, width)
        own = block @ block.T
        np.fill_diagonal(own, -np.inf)
        k = min(len(batch), 2 * DEGREE)
        near = np.argpartition(-own, k - 1, axis=1)[:, :k]
        near_sims = np.take_along_axis(own, near, 1)
        chosen = _diverse(np.concatenate([sims, near_sims], 1),
                          np.concatenate([np.maximum(ids, 0), batch[near]], 1), vectors, DEGREE)
        graph.ground[batch, :DEGREE] = chosen
        s, t = np.nonzero(chosen >= 0)
        _link_back(graph, batch[s], chosen[s, t])
    return graph


def within(graph: Graph, queries: np.ndarray, least: float, width: int) -> np.ndarray:
    """Boolean (query, node): nodes found with a similarity of ``least`` or more.

    A beam that ends among such nodes is widened as far as they reach: their
    neighbours are tried until none is new.
    """
    n = len(graph.vectors)
    out = np.zeros((len(queries), n), bool)
    for at in range(0, len(queries), BATCH):
        block = queries[at:at + BATCH]
        entry = (_descend(graph, block) if graph.layers
                 else np.zeros((len(block), 1), np.int64))
        ids, sims, seen = beam(block, graph.vectors, graph.ground, entry, width)
        q, place = np.nonzero(sims >= least)
        node = ids[q, place]
        while len(q):
            out[at + q, node] = True
            near = graph.ground[node]
            pair = (np.repeat(q, near.shape[1]) * (n + 1) + near.ravel())[near.ravel() >= 0]
            q, node = np.divmod(np.unique(pair), n + 1)
            new = ~out[at + q, node]
            q, node = q[new], node[new]
            parts = [np.einsum("ed,ed->e", block[q[i:i + 65_536]], graph.vectors[node[i:i + 65_536]])
                     for i in range(0, len(q), 65_536)]
            near_enough = (np.concatenate(parts) >= least) if parts else np.empty(0, bool)
            q, node = q[near_enough], node[near_enough]
    return out


WANTED = 0.999


def recall(found: np.ndarray, true: np.ndarray) -> float:
    """Mean share found over the queries that have anything to find.

    Shares are averaged by query, so that one query with very many links hides no other.
    """
    total = true.sum(axis=1)
    some = total > 0
    return float(((found & true).sum(axis=1)[some] / total[some]).mean()) if some.any() else 1.0


def whole(graph: Graph, queries: np.ndarray, least: float) -> np.ndarray:
    """:func:`within` by comparing with every node, a block of queries at a time."""
    out = np.empty((len(queries), len(graph.vectors)), bool)
    for at in range(0, len(queries), BATCH):
        out[at:at + BATCH] = queries[at:at + BATCH] @ graph.vectors.T >= least
    return out


def _sample(n: int, size: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(n, size)).astype(int))


def audited_width(graph: Graph, least: float, width: int = 48, wanted: float = WANTED,
                  audits: int = 512) -> tuple[int, float]:
    """The first beam width, doubling, whose recall against brute force is as wanted.

    Members are audited, without their links to themselves.  Beyond an eighth of the shard
    a beam takes more memory and time than comparing all of it, which is width 0.
    """
    n = len(graph.vectors)
    chosen = _sample(n, audits)
    queries = graph.vectors[chosen]
    true = queries @ graph.vectors.T >= least
    true[np.arange(len(chosen)), chosen] = False
    while True:
        reached = recall(within(graph, queries, least, width), true)
        if reached >= wanted:
            return width, reached
        width *= 2
        if 8 * width > n:
            return 0, 1.0


def audited_within(graph: Graph, queries: np.ndarray, least: float, width: int,
                   wanted: float = WANTED, audits: int = 256) -> np.ndarray:
    """:func:`within` for queries that are not the graph's own, audited anew.

    The beam doubles from ``width`` until the recall of a sample of them is as wanted; beyond
    an eighth of the shard, and for width 0, all of it is compared.
    """
    chosen = _sample(len(queries), audits)
    true = queries[chosen] @ graph.vectors.T >= least
    while 0 < 8 * width <= len(graph.vectors):
        found = within(graph, queries, least, width)
        if recall(found[chosen], true) >= wanted:
            return found
        width *= 2
    return whole(graph, queries, least)
