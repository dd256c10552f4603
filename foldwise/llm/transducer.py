"""Minimal acyclic transducer over sorted words, with lexicographic ordinals.

A word is a path of bytes from the root to a final state.  Equal right languages share a
state, so the automaton is minimal.  A transition carries the number of words that come before
all words through it among the words of its state; the sum along a path is the word's
ordinal in byte order.

``Builder`` takes words in ascending byte order and keeps one state for each different right
language (a register), so memory follows the automaton, not the list.  ``Transducer.walk``
streams a block of bytes through it: all words of the block advance by one byte in each
step, by binary search over the sorted transitions.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: ASCII letters and all bytes of other characters; A-Z become a-z.
LETTERS = np.zeros(256, np.uint8)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 256)


class Builder:
    """Incremental construction from sorted words."""

    def __init__(self):
        # a state: (final, ((byte, target state number), ...)) in ascending byte order
        self.register: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.path: list[list] = [[False, []]]  # states of the last word that are not yet in the register
        self.last: bytes | None = None

    def _freeze(self, down_to: int) -> None:
        """Give the states of the path below depth ``down_to`` their numbers."""
        while len(self.path) - 1 > down_to:
            final, edges = self.path.pop()
            self.path[-1][1][-1][1] = self._number(final, edges)

    def _number(self, final: bool, edges: list) -> int:
        key = (final, tuple(map(tuple, edges)))
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.states)
            self.states.append(key)
        return found

    def add(self, word: bytes) -> None:
        if self.last is not None and word <= self.last:
            raise ValueError("words must ascend")
        last, common = self.last or b"", 0
        for a, b in zip(last, word):
            if a != b:
                break
            common += 1
        self._freeze(common)
        for byte in word[common:]:
            self.path[-1][1].append([byte, -1])
            self.path.append([False, []])
        self.path[-1][0] = True
        self.last = word

    def finish(self) -> Transducer:
        self._freeze(0)
        root = self._number(*self.path[0])
        below = np.zeros(len(self.states), np.int64)  # words from a state on; targets have smaller numbers
        keys, targets, skips = [], [], []
        for number, (final, edges) in enumerate(self.states):
            n = int(final)
            for byte, target in edges:
                keys.append(number << 8 | byte)
                targets.append(target)
                skips.append(n)
                n += int(below[target])
            below[number] = n
        return Transducer(np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int64),
                          np.array([f for f, _ in self.states], bool), root, int(below[root]))


class Transducer:
    def __init__(self, keys: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, root: int, n_words: int):
        self.keys, self.targets, self.skips, self.final, self.root, self.n_words = keys, targets, skips, final, root, n_words

    @classmethod
    def of(cls, words: Iterable[bytes]) -> Transducer:
        builder = Builder()
        for w in words:
            builder.add(w)
        return builder.finish()

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), len(self.final), self.root, self.n_words], "<i8")
        return b"".join([head.tobytes(), self.keys.astype("<i8").tobytes(), self.skips.astype("<i8").tobytes(),
                         self.targets.astype("<i4").tobytes(), self.final.astype(np.uint8).tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        n_edges, n_states, root, n_words = np.frombuffer(data, "<i8", 4).tolist()
        at = 32
        keys = np.frombuffer(data, "<i8", n_edges, at)
        skips = np.frombuffer(data, "<i8", n_edges, at + 8 * n_edges)
        targets = np.frombuffer(data, "<i4", n_edges, at + 16 * n_edges)
        final = np.frombuffer(data, np.uint8, n_states, at + 20 * n_edges).astype(bool)
        return cls(keys, targets, skips, final, root, n_words)

    def walk(self, block: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ordinal of each word of ``block`` (-1: not in the list)."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            if self.n_words:  # the empty word alone
                out[lengths == 0] = 0
            return out
        word = np.arange(len(starts))
        state, ordinal, step = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64), 0
        while len(word):
            ends = lengths[word] == step
            if ends.any():
                hit = ends & self.final[state]
                out[word[hit]] = ordinal[hit]
                rest = ~ends
                word, state, ordinal = word[rest], state[rest], ordinal[rest]
                if not len(word):
                    break
            key = state << 8 | block[starts[word] + step]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            on = self.keys[at] == key
            at = at[on]
            word, state, ordinal = word[on], self.targets[at].astype(np.int64), ordinal[on] + self.skips[at]
            step += 1
        return out

    def word(self, ordinal: int) -> bytes:
        """The word of an ordinal."""
        if not 0 <= ordinal < self.n_words:
            raise IndexError(ordinal)
        out, state = bytearray(), self.root
        while ordinal or not self.final[state]:
            first, last = np.searchsorted(self.keys, [state << 8, (state + 1) << 8])
            at = first + int(np.searchsorted(self.skips[first:last], ordinal, "right")) - 1
            out.append(int(self.keys[at]) & 255)
            ordinal -= int(self.skips[at])
            state = int(self.targets[at])
        return bytes(out)


def words_of(block: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters in a block of texts: (block in lower case, starts, lengths, text of each).

    ``texts`` are the ends of the texts in the block; a run ends where its text does."""
    low = LETTERS[block]
    inside = np.empty(len(block) + 1, bool)
    inside[:-1] = low != 0
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    first = texts[:-1]  # where a text begins, a run that goes on is another one
    first = first[first < len(block)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(~inside)
    lengths = stops[np.searchsorted(stops, starts)] - starts
    of = np.searchsorted(texts, starts, "right")
    return low, starts, np.minimum(lengths, texts[of] - starts), of
