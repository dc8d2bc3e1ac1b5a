"""A bounded two-generation cache for per-chunk results inside one Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class ChunkCache:
    """Maps text chunks to bytes; what was not used since the last turnover goes.

    Holds at most 2 * entries chunks of at most max_chars characters; longer ones are computed anew.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]], entries: int = 250_000, max_chars: int = 48):
        self.compute, self.entries, self.max_chars = compute, entries, max_chars
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def ensure(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """A mapping that holds all these chunks (and others)."""
        if len(self.now) >= self.entries:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        missing = set(chunks).difference(now)
        if not missing:
            return now
        fresh = []
        for chunk in missing:
            if (value := before.get(chunk)) is None:
                fresh.append(chunk)
            else:
                now[chunk] = value
        long = {}
        for chunk, value in zip(fresh, self.compute(fresh), strict=True):
            (now if len(chunk) <= self.max_chars else long)[chunk] = value
        return _Both(now, long) if long else now


class _Both:
    def __init__(self, first: dict, second: dict):
        self.first, self.second = first, second

    def __getitem__(self, key: str) -> bytes:
        value = self.first.get(key)
        return self.second[key] if value is None else value
