"""A compressed full-text index of word numbers: Burrows-Wheeler transform in a wavelet matrix.

The text is a row of sequences, each closed by an end mark that sorts before all words and before the
later end marks. Backward search runs for many patterns at once: every step is a rank
query on each level of the wavelet matrix for all of them together.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words with the number of set bits before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        depth = max(1, int(size - 1).bit_length())
        order = symbols
        for level in reversed(range(depth)):
            bits = ((order >> level) & 1).astype(np.uint8)
            v = BitVector(bits)
            self.levels.append((level, v, len(order) - v.ones))
            order = np.concatenate([order[bits == 0], order[bits == 1]])
        everything = np.arange(size)
        self.begin = self._walk(everything, np.zeros(size, dtype=np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, v, zeros in self.levels:
            r = v.rank(i)
            i = np.where((c >> level) & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol ``c`` before place ``i``, for each pair."""
        return self._walk(c, i) - self.begin[c]


class FMIndex:
    """Index of sequences of words for matches of ``depth`` words.

    ``words``: all sequences' word hashes one after the other; ``lengths``: of each sequence.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int):
        self.depth, self.lengths = depth, lengths
        _, numbers = np.unique(words, return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        n, marks = len(words) + len(lengths), len(lengths)
        self.text = np.zeros(n, dtype=np.int64)  # 0: an end mark
        inside = np.ones(n, dtype=bool)
        inside[self.starts + lengths] = False
        self.text[inside] = numbers + 1
        size = int(self.text.max(initial=0)) + 1
        # ranks by the first 1, 2, 4 ... words; end marks differ from each other
        one = self.text + marks - 1
        one[~inside] = np.arange(marks)
        ranks, reach = {1: one}, 1
        longest = int(lengths.max(initial=0)) + 1
        while reach < longest:
            ranks[2 * reach] = self._joined(ranks[reach], ranks[reach], reach)
            reach *= 2
        self.suffixes = np.argsort(ranks[reach], kind="stable")
        before = self.text[self.suffixes - 1]  # of the first suffix: the last end mark
        self.tree = WaveletMatrix(before, size)
        counts = np.bincount(self.text, minlength=size)
        self.less = np.concatenate([[0], np.cumsum(counts)])[:-1]
        short = self._groups(ranks, depth - 1)
        self.short_begin = np.flatnonzero(short)
        self.short_group = np.cumsum(short) - 1
        self.short_end = np.append(self.short_begin[1:], n)
        full = self._groups(ranks, depth)
        self.group = np.cumsum(full) - 1
        self.first = np.minimum.reduceat(self.suffixes, np.flatnonzero(full)) if n else self.suffixes

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        """Ranks of pairs (a[i], b[i + shift])."""
        key = a * (int(b.max(initial=0)) + 2)
        key[: len(b) - shift] += b[shift:] + 1
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.concatenate([[False], ranked[1:] != ranked[:-1]])
        out = np.empty(len(key), dtype=np.int64)
        out[order] = np.cumsum(fresh)
        return out

    def _groups(self, ranks: dict[int, np.ndarray], depth: int) -> np.ndarray:
        """Where, in order of suffixes, the first ``depth`` words change: the places of a shorter common prefix."""
        differs = np.zeros(len(self.suffixes), dtype=bool)
        differs[:1] = True
        at, part = 0, 1 << max(ranks).bit_length()
        while at < depth:
            while part not in ranks or at + part > depth:
                part //= 2
            place = self.suffixes + at
            r = np.where(place < len(self.text), ranks[part][np.minimum(place, len(self.text) - 1)], -1 - self.suffixes)
            differs[1:] |= r[1:] != r[:-1]
            at += part
        return differs

    def statistics(self):
        """Matching statistics of every sequence against the index, cut at ``depth``, right to left.

        Yields (sequences, places, first): for each window of ``depth`` words, the place in the text of
        its earliest occurrence. A search that has matched ``depth`` words drops its last one
        and takes in the word before.
        """
        lanes = np.arange(len(self.lengths))
        lo, hi = np.zeros(len(lanes), dtype=np.int64), np.full(len(lanes), len(self.text), dtype=np.int64)
        for step in range(int(self.lengths.max(initial=0))):
            alive = self.lengths[lanes] > step
            lanes, lo, hi = lanes[alive], lo[alive], hi[alive]
            place = self.lengths[lanes] - 1 - step
            if step >= self.depth:
                g = self.short_group[lo]
                lo, hi = self.short_begin[g], self.short_end[g]
            c = self.text[self.starts[lanes] + place]
            base = self.less[c]
            lo, hi = base + self.tree.rank(c, lo), base + self.tree.rank(c, hi)
            if step >= self.depth - 1:
                # found: the interval of all windows of these words
                yield lanes, place, self.first[self.group[lo]]

    def earliest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all windows: their place in the text, the place of their earliest occurrence, their sequence."""
        found = [(self.starts[lanes] + place, first, lanes) for lanes, place, first in self.statistics()]
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))
