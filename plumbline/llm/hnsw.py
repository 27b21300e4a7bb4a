"""A hierarchical navigable small-world graph over the unit vectors of one shard.

Nodes get a top layer by a hash of their id; every layer links near nodes, and a search walks
from the sparse top layer down. Insertion and search work on blocks of vectors in lockstep, so
all distances are matrix products. Everything is derived from ids and vectors: rebuilding a
shard anywhere gives the same graph.
"""

from __future__ import annotations

import numpy as np

LINKS = 16
BUILD_BEAM = 48
BLOCK = 128
EXPAND = 4
CHUNK = 50_000


def _layers(ids: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    share = (((mixed >> np.uint64(12)).astype(float)) + 0.5) / 2.0**52
    return np.floor(-np.log(share) / np.log(LINKS)).astype(int)


class Graph:
    def __init__(self, ids: np.ndarray, unit: np.ndarray):
        top = _layers(ids)
        # Higher nodes first: each layer is a prefix of the nodes, and node 0 enters the search.
        self.order = np.lexsort((ids, -top))
        self.unit = unit[self.order]
        sizes = [int((top >= layer).sum()) for layer in range(int(top.max(initial=0)) + 1)]
        self.layers: list[np.ndarray] = []
        for size in reversed(sizes):
            self.layers.insert(0, self._build(size))
        self._both_ways()

    def to_bytes(self) -> bytes:
        """Node order and links; the vectors are kept by the caller."""
        sizes = [len(layer) for layer in self.layers]
        parts = [np.array([len(sizes), *sizes]), self.order, *(layer.ravel() for layer in self.layers)]
        return np.concatenate(parts).astype(np.int32).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, unit: np.ndarray) -> Graph:
        graph, values = cls.__new__(cls), np.frombuffer(data, np.int32).astype(np.int64)
        sizes, at = values[1 : values[0] + 1], values[0] + 1
        graph.order = values[at : at + len(unit)]
        at += len(unit)
        graph.unit, graph.layers = unit[graph.order], []
        for size in sizes:
            graph.layers.append(values[at : at + size * 2 * LINKS].reshape(size, 2 * LINKS))
            at += size * 2 * LINKS
        graph._both_ways()
        return graph

    def given(self) -> np.ndarray:
        """The vectors in the order they were given."""
        out = np.empty_like(self.unit)
        out[self.order] = self.unit
        return out

    def _both_ways(self) -> None:
        # The bottom layer in both directions, so that every node is met by those it links to.
        n, links = len(self.order), self.layers[0]
        node, at = np.nonzero(links >= 0)
        both = np.unique(np.concatenate([node * n + links[node, at], links[node, at] * n + node]))
        self.first = np.searchsorted(both // n, np.arange(n + 1))
        self.next = both % n

    def _entry(self, q: np.ndarray) -> np.ndarray:
        """The nearest node found in the layers built so far, per query."""
        at = np.zeros((len(q), 1), dtype=int)
        for links in reversed(self.layers):
            at = self._beam(q, links, at, 4)[0][:, :1]
        return at

    def _build(self, size: int) -> np.ndarray:
        """Insert nodes in blocks: near nodes come from a beam search of the layer so far and
        from the block itself; links are chosen for spread and given back to the other end."""
        links = np.full((size, 2 * LINKS), -1, dtype=np.int64)
        for first in range(0, size, BLOCK):
            last = min(size, first + BLOCK)
            q, mine = self.unit[first:last], np.arange(first, last)
            inner = q @ q.T
            inner[np.arange(len(q))[:, None] <= np.arange(len(q))[None, :]] = -2.0
            near, score = np.tile(mine, (len(q), 1)), inner
            if first:
                entry = self._entry(q) if self.layers else np.zeros((len(q), 1), dtype=int)
                entry = np.where(entry < first, entry, 0)
                found, value = self._beam(q, links[:first], entry, BUILD_BEAM)
                near, score = np.hstack([found, near]), np.hstack([value, score])
            best = np.argsort(-score, axis=1, kind="stable")[:, :BUILD_BEAM]
            for i in range(len(q)):
                picks, values = near[i, best[i]], score[i, best[i]]
                picks = picks[values > -2.0]
                chosen = self._spread(first + i, picks, LINKS)
                links[first + i, : len(chosen)] = chosen
                for other in chosen:
                    self._give(links, other, first + i)
        return links

    def _spread(self, node: int, near: np.ndarray, most: int) -> np.ndarray:
        """Of ``near`` (nearest first), those nearer to ``node`` than to any chosen before; the
        nearest others fill half of what room is left, so that clusters of copies stay dense."""
        if len(near) <= most:
            return near
        vectors = self.unit[near]
        to_node, among = vectors @ self.unit[node], vectors @ vectors.T
        chosen: list[int] = []
        for i in range(len(near)):
            if len(chosen) == most:
                break
            if not chosen or to_node[i] > among[i, chosen].max():
                chosen.append(i)
        fill = [i for i in range(len(near)) if i not in set(chosen)]
        chosen += fill[: (most - len(chosen) + 1) // 2]
        return near[chosen]

    def _give(self, links: np.ndarray, node: int, to: int) -> None:
        row = links[node]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = to
            return
        near = np.append(row, to)
        near = near[np.argsort(-(self.unit[near] @ self.unit[node]), kind="stable")]
        chosen = self._spread(node, near, links.shape[1] - LINKS // 2)
        row[:] = -1
        row[: len(chosen)] = chosen

    def _beam(self, q: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes met from ``entry``, nearest first, with their cosines
        (-2 where fewer were met). Each step opens the best unopened nodes of every query."""
        n, rows = len(links), np.arange(len(q))[:, None]
        beam = min(beam, n)
        seen = np.zeros((len(q), n + 1), dtype=bool)
        seen[:, n] = True
        seen[rows, entry] = True
        nodes = np.full((len(q), beam), n)
        score = np.full((len(q), beam), -2.0)
        opened = np.ones((len(q), beam), dtype=bool)
        width = min(beam, entry.shape[1])
        nodes[:, :width], opened[:, :width] = entry[:, :width], False
        score[:, :width] = np.einsum("qkd,qd->qk", self.unit[entry[:, :width]], q)
        active = np.arange(len(q))
        while len(active):
            todo = np.where(opened[active], -3.0, score[active])
            pick = np.argsort(-todo, axis=1, kind="stable")[:, :EXPAND]
            at = np.arange(len(active))[:, None]
            real = todo[at, pick] > -3.0
            alive = real.any(axis=1)
            active, pick, real = active[alive], pick[alive], real[alive]
            if not len(active):
                break
            at = active[:, None]
            opened[at, pick] = True
            source = np.where(real, nodes[at, pick], n)
            table = np.where((source < n)[:, :, None], links[np.minimum(source, n - 1)], -1)
            new = table.reshape(len(active), -1)
            new = np.sort(np.where(new < 0, n, new), axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            new = np.where(seen[at, new], n, new)
            seen[at, new] = True
            seen[active, n] = True
            value = np.einsum("qkd,qd->qk", self.unit[np.minimum(new, n - 1)], q[active])
            value[new == n] = -2.0
            all_nodes = np.hstack([nodes[active], new])
            all_score = np.hstack([score[active], value])
            all_open = np.hstack([opened[active], new == n])
            keep = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
            row = np.arange(len(active))[:, None]
            nodes[active], score[active] = all_nodes[row, keep], all_score[row, keep]
            opened[active] = all_open[row, keep]
        return nodes, score

    def best(self, q: np.ndarray, beam: int, k: int) -> np.ndarray:
        """The ``k`` highest cosines that a beam finds per row of ``q``, highest first."""
        score = self._beam(q, self.layers[0], self._entry(q), max(beam, k))[1]
        return -np.sort(-score, axis=1)[:, :k]

    def within(self, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(row of q, position)`` of the vectors found at a cosine of ``threshold`` or
        more; positions are in the order the vectors were given. The beam's finds are spread
        along the links of all nodes in range, so a cluster larger than the beam is found whole
        without sorting it."""
        n, links = len(self.order), self.layers[0]
        nodes, score = self._beam(q, links, self._entry(q), beam)
        seen = np.zeros((len(q), n), dtype=bool)
        rows, columns = np.nonzero(nodes < n)
        seen[rows, nodes[rows, columns]] = True
        rows, columns = np.nonzero(score >= threshold)
        found = [(rows, nodes[rows, columns])]
        row, node = found[0]
        while len(row):
            count = self.first[node + 1] - self.first[node]
            start = np.repeat(self.first[node] - np.cumsum(count) + count, count)
            row, node = np.repeat(row, count), self.next[start + np.arange(count.sum())]
            fresh = ~seen[row, node]
            code = np.unique(row[fresh] * n + node[fresh])
            row, node = code // n, code % n
            seen[row, node] = True
            near = np.concatenate(
                [np.einsum("kd,kd->k", self.unit[node[i : i + CHUNK]], q[row[i : i + CHUNK]]) >= threshold
                 for i in range(0, len(node), CHUNK)] or [np.zeros(0, dtype=bool)]
            )
            row, node = row[near], node[near]
            found.append((row, node))
        row, node = (np.concatenate(x) for x in zip(*found))
        return row, self.order[node]
