"""A double-array trie over integer labels, walked from many positions at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Nodes with fewer children are placed together in rounds, the others one by one.
CROWD = 16
TRIES = 8


class Trie:
    """Node 0 is the root; the child of s by label w (from 1) is base[s] + w if check there is s."""

    def __init__(self, phrases: np.ndarray):
        """phrases: rows of labels from 1, with zeros behind shorter ones; rows are distinct."""
        n, depth = phrases.shape
        # parents before children: each level's distinct prefixes get numbers in turn
        prefix, parents, labels, total = np.zeros(n, np.int64), [], [], 1
        ends = np.zeros(n, np.int64)
        for d in range(depth):
            here = phrases[:, d] > 0
            edges, number = np.unique(np.stack((prefix[here], phrases[here, d]), axis=1), axis=0, return_inverse=True)
            parents.append(edges[:, 0])
            labels.append(edges[:, 1])
            prefix[here] = total + number.reshape(-1)
            ends[here] = prefix[here]
            total += len(edges)
        self._place(np.concatenate(parents), np.concatenate(labels), total)
        self.ends = self.slot_of[ends]  # where each phrase's walk ends
        del self.slot_of

    def _place(self, parents: np.ndarray, labels: np.ndarray, total: int) -> None:
        """Finds each node a base that puts all its children on free slots."""
        by_parent = np.argsort(parents, kind="stable")
        kids = labels[by_parent]
        size = np.bincount(parents, minlength=total)
        first = np.concatenate(([0], np.cumsum(size)))
        span = int(labels.max(initial=1))
        self.used = np.zeros(2 * total + 2 * span + 2, bool)
        self.used[0] = True
        base, rng, top = np.zeros(total, np.int64), np.random.default_rng(0), 1
        for s in sorted(np.flatnonzero(size >= CROWD).tolist(), key=lambda s: -size[s]):
            mine = kids[first[s] : first[s + 1]]
            for b in [*rng.integers(0, top, TRIES).tolist(), top]:
                self._room(b + span + 1)
                if not self.used[b + mine].any():
                    break
            base[s] = b
            self.used[b + mine] = True
            top = max(top, b + int(mine.max()) + 1)
        open_ = np.flatnonzero((size > 0) & (size < CROWD))
        reach = max(2 * total, top)
        while len(open_):
            self._room(reach + span + 1)
            proposed = rng.integers(0, reach, len(open_))
            counts = size[open_]
            owner = np.repeat(np.arange(len(open_)), counts)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            slots = proposed[owner] + kids[first[open_][owner] + within]
            _, winner = np.unique(slots, return_index=True)
            good = np.zeros(len(slots), bool)
            good[winner] = True
            good &= ~self.used[slots]
            placed = np.bincount(owner, good, len(open_)) == counts
            base[open_[placed]] = proposed[placed]
            self.used[slots[placed[owner]]] = True
            open_ = open_[~placed]
            reach += reach // 8
        slots = base[parents] + labels
        self.slot_of = np.zeros(total, np.int64)
        self.slot_of[1:] = slots  # node numbers follow the order of edges
        length = int(slots.max(initial=0)) + span + 2
        self.base, self.check = np.zeros(length, np.int32), np.full(length, -1, np.int32)
        self.base[self.slot_of] = base
        self.check[slots] = self.slot_of[parents]
        del self.used

    def _room(self, n: int) -> None:
        if n > len(self.used):
            self.used = np.concatenate((self.used, np.zeros(n, bool)))

    def steps(self, labels: np.ndarray | Callable[[np.ndarray], np.ndarray], depth: int, at: np.ndarray | None = None, end: int | None = None):
        """For 1, 2, ... depth labels read, the states of all positions from which they lead somewhere.

        labels may be a function that gives those at some of the places before end; at are the positions, all by default.
        """
        read, end = (labels, end) if callable(labels) else (labels.__getitem__, len(labels))
        at = np.arange(end) if at is None else at
        state = np.zeros(len(at), np.int64)
        for d in range(depth):
            inside = at + d < end
            at, state = at[inside], state[inside]
            label = read(at + d)
            to = self.base[state] + label
            good = (label > 0) & (self.check[to] == state)
            at, state = at[good], to[good]
            yield state
