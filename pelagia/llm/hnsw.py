"""A navigable small-world graph in numpy whose searches advance many queries in step."""

from __future__ import annotations

import io
import math

import numpy as np

DEGREE = 16
BUILD_BEAM = 48
BATCH = 128
EXPAND = 4


def _select(own: np.ndarray, ids: np.ndarray, sims: np.ndarray, vectors: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours for each row: nearest first, those closer to a chosen one than to the row only fill up."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = ids.shape
    valid = (ids >= 0) & (ids != own[:, None])
    for j in range(1, min(width, 4 * degree)):  # repeated candidates count once
        valid[:, j] &= ~((ids[:, :j] == ids[:, j : j + 1]) & valid[:, :j]).any(axis=1)
    found = vectors[np.maximum(ids, 0)]
    chosen = np.zeros_like(valid)
    for j in range(min(width, 4 * degree)):
        cross = np.einsum("rd,rkd->rk", found[:, j], found[:, : j + 1])[:, :j]
        nearer = (cross > sims[:, j : j + 1]) & chosen[:, :j]
        chosen[:, j] = valid[:, j] & ~nearer.any(axis=1) & (chosen[:, :j].sum(axis=1) < degree)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * width + np.arange(width)
    take = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(valid, take, 1), np.take_along_axis(ids, take, 1), -1)
    return np.pad(out, ((0, 0), (0, max(0, degree - out.shape[1]))), constant_values=-1)


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 holds all, each higher one a share of 1/DEGREE."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """Nodes go in by layer, the highest first, in batches no larger than what is in already."""
        n = len(vectors)
        rng = np.random.Generator(np.random.PCG64(n))
        height = np.minimum((-np.log(rng.random(n)) / math.log(DEGREE)).astype(int), 6)
        order = np.argsort(-height, kind="stable")
        graph = cls(np.ascontiguousarray(vectors[order]), [])
        height = height[order]
        for layer in range(int(height[0]) + 1 if n else 0):
            graph.layers.append(np.full((int((height >= layer).sum()), DEGREE * (2 if layer == 0 else 1)), -1, np.int32))
        done = 1
        while done < n:
            batch = np.arange(done, min(n, done + min(done, BATCH)))
            graph._insert(batch, done, height)
            done = batch[-1] + 1
        if n:
            graph._symmetric()
            graph._bridge()
        graph.order = order
        return graph

    def _symmetric(self) -> None:
        """Adds the missing reverse links of layer 0, the nearest first, to at most twice its degree."""
        links = self.layers[0]
        source, slot = np.nonzero(links >= 0)
        target = links[source, slot].astype(np.int64)
        n = len(links)
        missing = np.setdiff1d(target * n + source, source * n + target)
        at, to = missing // n, missing % n
        sims = np.einsum("rd,rd->r", self.vectors[at], self.vectors[to])
        by = np.lexsort((-sims, at))
        at, to = at[by], to[by]
        first = np.searchsorted(at, at, "left")
        place = (links >= 0).sum(axis=1)[at] + np.arange(len(at)) - first
        wide = np.full((n, 2 * links.shape[1]), -1, np.int32)
        packed = np.take_along_axis(links, np.argsort(links < 0, axis=1, kind="stable"), 1)
        wide[:, : links.shape[1]] = packed
        fits = place < wide.shape[1]
        wide[at[fits], place[fits]] = to[fits]
        self.layers[0] = wide

    def _bridge(self) -> None:
        """Links nodes that the entry doesn't reach from the reached nodes nearest to them."""
        while True:
            links = self.layers[0]
            reached = np.zeros(len(links), bool)
            front = np.zeros(1, np.int64)
            reached[0] = True
            while len(front):
                new = np.unique(links[front])
                new = new[new >= 0]
                front = new[~reached[new]]
                reached[front] = True
            lost = np.flatnonzero(~reached)[:256]
            if not len(lost):
                return
            known = np.flatnonzero(reached)
            best = known[np.argmax(self.vectors[lost] @ self.vectors[known].T, axis=1)]
            used = (links >= 0).sum(axis=1)
            for node, at in zip(lost, best, strict=True):
                if used[at] == self.layers[0].shape[1]:
                    self.layers[0] = np.pad(self.layers[0], ((0, 0), (0, 8)), constant_values=-1)
                self.layers[0][at, used[at]] = node
                used[at] += 1

    def _insert(self, batch: np.ndarray, done: int, height: np.ndarray) -> None:
        queries = self.vectors[batch]
        enter = np.zeros(len(batch), np.int64)
        mutual = queries @ queries.T
        np.fill_diagonal(mutual, -2.0)
        near = np.argsort(-mutual, axis=1)[:, :8]
        for layer in range(len(self.layers) - 1, -1, -1):
            inside = height[batch] >= layer
            if not inside.any():
                enter = self._beam(queries, enter, 1, layer)[0][:, 0]
                continue
            ids, sims = self._beam(queries, enter, BUILD_BEAM, layer)
            enter = ids[:, 0]
            peers = batch[near]
            peer_sims = np.where(height[peers] >= layer, np.take_along_axis(mutual, near, 1), -2.0)
            ids = np.concatenate((ids, np.where(peer_sims > -2, peers, -1)), axis=1)[inside]
            sims = np.concatenate((sims, peer_sims), axis=1)[inside]
            own, links = batch[inside], self.layers[layer]
            links[own, :DEGREE] = _select(own, ids, sims, self.vectors, DEGREE)
            self._link_back(own, links)

    def _link_back(self, own: np.ndarray, links: np.ndarray) -> None:
        targets = links[own, :DEGREE]
        source = np.repeat(own, DEGREE)[targets.ravel() >= 0]
        target = targets.ravel()[targets.ravel() >= 0]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(count.max()) if len(count) else 0), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.concatenate((links[nodes], extra), axis=1)
        full = (both >= 0).sum(axis=1) > links.shape[1]
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : links.shape[1]]
        links[nodes[~full]] = packed[~full]
        if full.any():
            cand, at = both[full], nodes[full]
            sims = np.where(cand >= 0, np.einsum("rd,rkd->rk", self.vectors[at], self.vectors[np.maximum(cand, 0)]), -2.0)
            links[at] = _select(at, cand, sims, self.vectors, links.shape[1])

    def _beam(self, queries: np.ndarray, enter: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the best nodes found for each query, best first; -1 and -2 where there are fewer."""
        links, rows = self.layers[layer], len(queries)
        ids = np.full((rows, width), -1, np.int64)
        sims = np.full((rows, width), -2.0, np.float32)
        ids[:, 0], sims[:, 0] = enter, np.einsum("rd,rd->r", queries, self.vectors[enter])
        expanded = np.zeros((rows, width), bool)
        seen = np.zeros((rows, len(links)), bool)
        seen[np.arange(rows), enter] = True
        live = np.arange(rows)
        step = 1 if width == 1 else EXPAND
        while len(live):
            open_ = (ids[live] >= 0) & ~expanded[live]
            live = live[open_.any(axis=1)]
            if not len(live):
                break
            open_ = (ids[live] >= 0) & ~expanded[live]
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :step]
            usable = np.take_along_axis(open_, pick, 1)
            here = live[:, None]
            expanded[here, pick] |= usable
            near = links[np.where(usable, ids[here, pick], 0)]
            near = np.where(usable[:, :, None], near, -1).reshape(len(live), -1)
            fresh = near >= 0
            fresh &= ~seen[here, np.maximum(near, 0)]
            near = np.where(fresh, near, -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            r, c = np.nonzero(near >= 0)
            new = near[r, c]
            seen[live[r], new] = True
            more = np.full(near.shape, -2.0, np.float32)
            more[r, c] = np.einsum("rd,rd->r", queries[live[r]], self.vectors[new])
            all_ids, all_sims = np.concatenate((ids[live], near), 1), np.concatenate((sims[live], more), 1)
            all_done = np.concatenate((expanded[live], np.zeros(near.shape, bool)), 1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live], sims[live], expanded[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_done, top, 1)
        return ids, sims

    def nearest(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities that a beam of this width ends with, best first; -1 and -2 where there are fewer."""
        enter = np.zeros(len(queries), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            enter = self._beam(queries, enter, 1, layer)[0][:, 0]
        return self._beam(queries, enter, min(width, len(self.vectors)), 0)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, order=self.order, **{f"layer{i}": x for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, vectors: np.ndarray) -> Graph:
        """The graph over the unit vectors that it was built from, in their own order."""
        parts = np.load(io.BytesIO(data))
        graph = cls(np.ascontiguousarray(vectors[parts["order"]]), [parts[f"layer{i}"] for i in range(len(parts.files) - 1)])
        graph.order = parts["order"]
        return graph
