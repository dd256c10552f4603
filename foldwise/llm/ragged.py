"""Rows of different lengths in one flat array, and a bounded memory of them by key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many spans, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Rows:
    """Rows kept one after the other in a flat array that grows."""

    def __init__(self, dtype=np.uint32):
        self.flat, self.used = np.empty(1024, dtype), 0
        self.starts, self.lengths, self.n = np.empty(256, np.int64), np.empty(256, np.int32), 0

    @staticmethod
    def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(a):
            return a
        wide = np.empty(max(used + more, 2 * len(a)), a.dtype)
        wide[:used] = a[:used]
        return wide

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> range:
        """Add rows; the numbers they get."""
        k = len(lengths)
        self.flat = self._room(self.flat, self.used, len(flat))
        self.starts = self._room(self.starts, self.n, k)
        self.lengths = self._room(self.lengths, self.n, k)
        self.flat[self.used:self.used + len(flat)] = flat
        self.starts[self.n:self.n + k] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n:self.n + k] = lengths
        self.used += len(flat)
        self.n += k
        return range(self.n - k, self.n)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat, lengths) of the rows with these numbers."""
        lengths = self.lengths[at].astype(np.int64)
        return self.flat[spans(self.starts[at], lengths)], lengths


class Memo:
    """key -> row of values; ``make`` gives the rows of many new keys at once.

    Two generations of at most ``most`` entries and ``most_bytes`` of keys each, and the
    keys of one call: when the young one is full it becomes the old one, and keys of the
    old one that come again move on.  So frequent keys stay, and memory is bounded."""

    def __init__(self, make: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int, dtype=np.uint32, most_bytes: int = 8 << 20):
        self.make, self.most, self.most_bytes, self.dtype = make, most, most_bytes, dtype
        self.index, self.rows, self.bytes = {}, Rows(dtype), 0
        self.old_index, self.old_rows = {}, Rows(dtype)

    def _add(self, keys: list, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.index.update(zip(keys, self.rows.append(flat, lengths)))
        self.bytes += sum(len(k) for k in keys if isinstance(k, bytes))

    def take(self, keys: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """(flat, lengths) of the rows of ``keys``, in their order."""
        if not keys:
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        new = [k for k in dict.fromkeys(keys) if k not in self.index]
        if new and (len(self.index) + len(new) > self.most or self.bytes > self.most_bytes):
            self.old_index, self.old_rows = self.index, self.rows
            self.index, self.rows, self.bytes = {}, Rows(self.dtype), 0
            new = list(dict.fromkeys(keys))
        if new:
            again = [k for k in new if k in self.old_index]
            if again:
                at = np.fromiter(map(self.old_index.__getitem__, again), np.int64, len(again))
                self._add(again, *self.old_rows.take(at))
                new = [k for k in new if k not in self.old_index]
            if new:
                self._add(new, *self.make(new))
        return self.rows.take(np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys)))


def joined(memo: Memo, keys: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """(flat, lengths) of rows that are each the rows of several keys, one after the other."""
    flat, size = memo.take([k for row in keys for k in row])
    of = np.repeat(np.arange(len(keys)), [len(row) for row in keys])
    return flat, np.bincount(of, weights=size, minlength=len(keys)).astype(np.int64)
