"""Hierarchical navigable small-world graphs over unit vectors, in NumPy; searches and inserts run in batches."""

from __future__ import annotations

import numpy as np

LINKS = 24  # links of a node on each layer
BUILD_BEAM = 48
SPREAD = 6  # one node in so many reaches the next layer
BATCH = 512


def select(near: np.ndarray, sims: np.ndarray, x: np.ndarray, links: int) -> np.ndarray:
    """Links for each row among its candidates (best first, -1 for none): (rows, links).

    A candidate is taken if it is closer to the row's vector than to every
    candidate taken before; free places go to the best of the others.
    """
    order = np.argsort(-np.where(near >= 0, sims, -9), 1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = near.shape
    v = x[np.maximum(near, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    taken, count = np.zeros((rows, width), bool), np.zeros(rows, int)
    for c in range(width):
        ok = (near[:, c] >= 0) & (count < links) & ~((between[:, c] > sims[:, c, None]) & taken).any(1)
        taken[:, c] = ok
        count += ok
    rank = np.argsort(~taken, 1, kind="stable")[:, :links]
    out = np.take_along_axis(near, rank, 1)
    if out.shape[1] < links:
        out = np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)
    return out


def expanded(beam: int) -> int:
    """Nodes of a beam that are expanded at once: more in a wide beam, which would take many steps otherwise."""
    return max(4, beam // 12)


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `beam` nodes found from `start` (rows, any) for each query: (ids, similarities), best first, -1 for none."""
    n, rows = len(x), len(queries)
    seen = np.zeros((rows, n + 1), bool)
    ids = np.full((rows, beam), -1)
    sims = np.full((rows, beam), -9.0, np.float32)
    done = np.zeros((rows, beam), bool)
    at = np.arange(rows)[:, None]

    def offer(live: np.ndarray, new: np.ndarray) -> None:
        nonlocal ids, sims, done
        new = np.sort(new, 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        own = at[live]
        new = np.where(seen[own, new], -1, new)
        seen[own, new] = True
        seen[:, n] = False
        value = np.einsum("qcd,qd->qc", x[np.maximum(new, 0)], queries[live]).astype(np.float32)
        value[new < 0] = -9
        i, s, d = np.concatenate([ids[live], new], 1), np.concatenate([sims[live], value], 1), np.concatenate([done[live], np.zeros(new.shape, bool)], 1)
        if i.shape[1] > beam:
            top = np.argpartition(-s, beam - 1, 1)[:, :beam]
            i, s, d = (np.take_along_axis(a, top, 1) for a in (i, s, d))
        ids[live], sims[live], done[live] = i, s, d

    live = np.arange(rows)
    offer(live, start.astype(np.int64))
    wide = min(expanded(beam), beam)
    while True:
        open_ = np.where(done[live] | (ids[live] < 0), -9.0, sims[live])
        some = open_.max(1) > -9
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        best = np.argpartition(-open_, wide - 1, 1)[:, :wide]
        usable = np.take_along_axis(open_, best, 1) > -9
        flags = done[live]
        np.put_along_axis(flags, best, True, 1)
        done[live] = flags
        nodes = np.where(usable, np.take_along_axis(ids[live], best, 1), -1)
        new = np.where(nodes[:, :, None] >= 0, graph[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
        offer(live, new)
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def build_layer(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A navigable graph (n, LINKS) over the rows of x; batches of new nodes search what stands already."""
    n = len(x)
    graph = np.full((n, LINKS), -1)
    order = rng.permutation(n)
    at = min(n, 64)
    first = order[:at]
    sims = x[first] @ x[first].T
    np.fill_diagonal(sims, -9)
    near = np.broadcast_to(first, (at, at)).copy()
    near[np.arange(at), np.arange(at)] = -1
    graph[first] = select(near, sims, x, LINKS)
    while at < n:
        new = order[at : at + min(BATCH, at)]
        entry = order[np.linspace(0, at - 1, 8).astype(int)]
        near, sims = beam_search(x, graph, x[new], np.tile(entry, (len(new), 1)), BUILD_BEAM)
        peers = x[new] @ x[new].T
        np.fill_diagonal(peers, -9)
        k = min(16, len(new) - 1)
        if k > 0:
            top = np.argpartition(-peers, k - 1, 1)[:, :k]
            near, sims = np.concatenate([near, new[top]], 1), np.concatenate([sims, np.take_along_axis(peers, top, 1)], 1)
        graph[new] = select(near, sims, x, LINKS)
        # links back: each linked node keeps the best of its old links and of the nearest 24 new ones
        src, dst = np.repeat(new, LINKS), graph[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        value = np.einsum("ed,ed->e", x[src], x[dst])
        by = np.lexsort((-value, dst))
        src, dst, value = src[by], dst[by], value[by]
        nodes, begin = np.unique(dst, return_index=True)
        rank = np.arange(len(dst)) - np.repeat(begin, np.diff(np.append(begin, len(dst))))
        row = np.searchsorted(nodes, dst)
        ok = rank < 24
        extra = np.full((len(nodes), 24), -1)
        extra[row[ok], rank[ok]] = src[ok]
        for i in range(0, len(nodes), BATCH):
            own = nodes[i : i + BATCH]
            cand = np.concatenate([graph[own], extra[i : i + BATCH]], 1)
            cand.sort(1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            s = np.einsum("ncd,nd->nc", x[np.maximum(cand, 0)], x[own])
            graph[own] = select(cand, s, x, LINKS)
        at += len(new)
    return graph


def build(x: np.ndarray, seed: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Layers from the top: (members of each layer as rows of x, links as places among the members)."""
    rng = np.random.default_rng(seed)
    members = [np.arange(len(x))]
    while len(members[-1]) > 64:
        members.append(np.sort(rng.choice(members[-1], max(1, len(members[-1]) // SPREAD), replace=False)))
    members.reverse()
    return members, [build_layer(x[m], rng) for m in members]


def search(x: np.ndarray, layers: tuple[list[np.ndarray], list[np.ndarray]], queries: np.ndarray, beam: int, own_rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best `beam` rows of x found for each query, down through the layers; own_rows are the queries' rows of x, if they have any."""
    members, graphs = layers
    start = np.zeros((len(queries), 1), np.int64)
    for depth, (own, graph) in enumerate(zip(members, graphs, strict=True)):
        last = depth == len(members) - 1
        if last and own_rows is not None:
            start = np.concatenate([own_rows[:, None], start], 1)
        ids, sims = beam_search(x[own], graph, queries, start, min(beam if last else 8, len(own)))
        if last:
            return ids, sims
        found = own[np.maximum(ids, 0)]  # every layer's members are members of the next
        start = np.searchsorted(members[depth + 1], found)
    raise ValueError("no layers")
