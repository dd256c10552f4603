"""Ids of plain words, looked up for whole blocks of text at once.

A block's bytes are classed by table: white space, letters, digits, marks.  Words of printable ASCII other
than the apostrophe and of Latin-1 letters fall into parts (runs of letters, single digits, runs of marks)
which are looked up, in lower case, by their own bytes: up to 24 of them as three 64-bit numbers, so that
equal keys are equal parts.  Any other word (apostrophes, special strings, longer parts, other scripts)
takes ``slow``.  That matches the word pattern of ``tokens.Encoder``, which checks that the file has it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from foldwise.llm.ragged import Memo, Rows, spans

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
#: Bytes of a part that its key holds.
WIDEST = 24

CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x21:0x7F] = MARK
CLASS[0x27] = OTHER  # the apostrophe can begin a part of its own
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER
CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def keys_of(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, three numbers) of parts; ``low`` goes on for at least ``WIDEST`` + 8 bytes after the last."""
    words = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    key = np.empty((3, len(starts)), np.uint64)
    mixed = np.zeros(len(starts), np.uint64)
    for i in range(3):
        key[i] = words[starts + 8 * i] & KEEP[np.clip(lengths - 8 * i, 0, 8)]
        mixed = (mixed ^ key[i]) * MIX[i]
        mixed ^= mixed >> np.uint64(29)
    return mixed, key


class _Generation:
    def __init__(self):
        self.hash, self.key, self.row, self.rows = np.empty(0, np.uint64), np.empty((3, 0), np.uint64), np.empty(0, np.int64), Rows()

    def find(self, mixed: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for those that are not here."""
        if not len(self.hash):
            return np.full(len(mixed), -1, np.int64)
        at = np.searchsorted(self.hash, mixed)
        at[at == len(self.hash)] = 0
        same = self.hash[at] == mixed
        for i in range(3):
            same &= self.key[i][at] == key[i]
        return np.where(same, self.row[at], -1)

    def add(self, mixed: np.ndarray, key: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        row = np.array(self.rows.append(flat, lengths), np.int64)
        mixed, key, row = np.concatenate([self.hash, mixed]), np.concatenate([self.key, key], axis=1), np.concatenate([self.row, row])
        order = np.argsort(mixed, kind="stable")
        self.hash, self.key, self.row = mixed[order], key[:, order], row[order]


class PartIds:
    """``make`` gives the ids of new parts; ``slow`` those of other words.  Parts are remembered in two
    generations of at most ``most`` and those of one call (see ``ragged.Memo``)."""

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], slow: Memo, special: Sequence[bytes], most: int):
        self.make, self.slow, self.most = make, slow, most
        self.special = sorted({s[:2] for s in special})
        self.young, self.old = _Generation(), _Generation()

    def _rows(self, low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Row numbers of the parts in the young generation."""
        mixed, key = keys_of(low, starts, lengths)
        row = self.young.find(mixed, key)
        new = np.flatnonzero(row < 0)
        if not len(new):
            return row
        _, first = np.unique(mixed[new], return_index=True)
        if len(self.young.hash) + len(first) > self.most:
            self.old, self.young = self.young, _Generation()
            new = np.arange(len(starts))  # row numbers start anew
            _, first = np.unique(mixed, return_index=True)
        once = new[first]
        again = self.old.find(mixed[once], key[:, once])
        known = again >= 0
        if known.any():
            self.young.add(mixed[once[known]], key[:, once[known]], *self.old.rows.take(again[known]))
        once = once[~known]
        if len(once):
            text = low.tobytes()
            made = self.make([text[a:b] for a, b in zip(starts[once].tolist(), (starts[once] + lengths[once]).tolist())])
            self.young.add(mixed[once], key[:, once], *made)
        row[new] = self.young.find(mixed[new], key[:, new])
        for i in np.flatnonzero(row < 0).tolist():  # another part of the same hash came first
            part = low[starts[i]:starts[i] + lengths[i]].tobytes()
            row[i] = self.young.rows.append(*self.make([part]))[0]
        return row

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each text)."""
        joined = b" ".join([*texts, bytes(WIDEST + 8)])
        raw = np.frombuffer(joined, np.uint8)
        cls, low = CLASS[raw], LOWER[raw]
        lead = np.flatnonzero(raw == 0xC3)  # U+00C0 to U+00FF
        second = raw[lead + 1]
        sign = (second == 0x97) | (second == 0xB7)  # the only two that are no letters
        cls[lead] = cls[lead + 1] = np.where(sign, MARK, LETTER)
        low[lead + 1] = np.where((second < 0x9F) & ~sign, second + 0x20, second)
        cls[len(raw) - WIDEST - 8:] = SPACE

        before = np.empty_like(cls)
        before[0], before[1:] = SPACE, cls[:-1]
        space = cls == SPACE
        word_starts = np.flatnonzero(~space & (before == SPACE))
        if not len(word_starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        word_ends = np.flatnonzero(space & (before != SPACE))
        begins = ~space & ((cls != before) | (cls == DIGIT))
        borders = np.flatnonzero(begins | space)
        is_start = begins[borders]
        starts, ends = borders[is_start], borders[1:][is_start[:-1]]
        lengths = ends - starts
        number = np.cumsum(~space & (before == SPACE)) - 1
        of = number[starts]

        odd = np.zeros(len(word_starts), bool)
        odd[number[cls == OTHER]] = True
        odd[of[lengths > WIDEST]] = True
        for s in self.special:
            pair = (raw[:-1] == s[0]) & (raw[1:] == s[1]) if len(s) == 2 else raw[:-1] == s[0]
            odd[number[:-1][pair]] = True
        plain = ~odd[of]
        places, starts, lengths = starts[plain], starts[plain], lengths[plain]
        row = self._rows(low, starts, lengths)
        store = self.young.rows
        at, size = store.starts[row], store.lengths[row].astype(np.int64)
        flat = store.flat
        if odd.any():
            slow_starts = word_starts[odd]
            more, more_size = self.slow.take([joined[a:b] for a, b in zip(slow_starts.tolist(), word_ends[odd].tolist())])
            at = np.concatenate([at, store.used + np.cumsum(more_size) - more_size])
            size, places = np.concatenate([size, more_size]), np.concatenate([places, slow_starts])
            flat = np.concatenate([flat[:store.used], more])
            order = np.argsort(places, kind="stable")
            at, size, places = at[order], size[order], places[order]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(places, text_ends)]
        return flat[spans(at, size)], np.diff(upto, prepend=0)
