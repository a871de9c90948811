"""Elias-Fano coding of a non-decreasing sequence, with select.

Each value is cut into ``width`` low bits, stored as they are, and a high part, stored in unary:
bit ``high + i`` is set for value ``i``. With width = floor(log2(universe / n)) this takes
about 2 + log2(universe / n) bits a value. select(i) finds the i-th set bit through
a count of set bits before every 512 bits and needs no table of values.
"""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<QQB7x")
BLOCK = 512


def width_for(n: int, universe: int) -> int:
    return max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)


def encode(values: np.ndarray) -> bytes:
    """``values``: non-decreasing, from 0."""
    values = np.asarray(values, dtype=np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    if n and (np.diff(values.astype(np.int64)) < 0).any():
        raise ValueError("the sequence decreases")
    width = width_for(n, top)
    low_bits = np.zeros(n * width, dtype=np.uint8)
    for b in range(width):
        low_bits[b::width] = (values >> np.uint64(b)) & np.uint64(1)
    high = (values >> np.uint64(width)).astype(np.int64)
    high_bits = np.zeros((int(high[-1]) + n) if n else 0, dtype=np.uint8)
    high_bits[high + np.arange(n)] = 1
    return HEADER.pack(n, top, width) + np.packbits(low_bits, bitorder="little").tobytes() + np.packbits(high_bits, bitorder="little").tobytes()


class EliasFano:
    """A coded sequence; only the counts before each block are added to the coded bytes."""

    def __init__(self, data: bytes):
        self.n, self.top, self.width = HEADER.unpack_from(data)
        low = -(-self.n * self.width // 8)
        self.low = np.frombuffer(data, dtype=np.uint8, count=low, offset=HEADER.size)
        high_len = -(-((self.top >> self.width) + self.n) // 8) if self.n else 0
        self.high = np.frombuffer(data, dtype=np.uint8, count=high_len, offset=HEADER.size + low)
        self.size = HEADER.size + low + high_len
        padded = np.zeros(-(-high_len * 8 // BLOCK) * BLOCK // 8, dtype=np.uint8)
        padded[:high_len] = self.high
        per_block = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(per_block)])

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        begin = block * BLOCK // 8
        bits = np.unpackbits(self.high[begin : begin + BLOCK // 8], bitorder="little")
        place = block * BLOCK + int(np.flatnonzero(bits)[i - self.before[block]])
        return ((place - i) << self.width) | self._low(i)

    def _low(self, i: int) -> int:
        begin = i * self.width
        raw = int.from_bytes(self.low[begin // 8 : (begin + self.width + 7) // 8].tobytes(), "little")
        return (raw >> begin % 8) & ((1 << self.width) - 1)

    def values(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Values ``begin`` to ``end`` (exclusive) in one pass over their blocks."""
        end = self.n if end is None else min(end, self.n)
        if begin >= end:
            return np.zeros(0, dtype=np.int64)
        first = int(np.searchsorted(self.before, begin, side="right")) - 1
        last = int(np.searchsorted(self.before, end - 1, side="right")) - 1
        bits = np.unpackbits(self.high[first * BLOCK // 8 : (last + 1) * BLOCK // 8], bitorder="little")
        own = np.flatnonzero(bits)[begin - self.before[first] : end - self.before[first]] + first * BLOCK
        high = own - np.arange(begin, end)
        if not self.width:
            return high.astype(np.int64)
        low_bits = np.unpackbits(self.low[begin * self.width // 8 : -(-end * self.width // 8)], bitorder="little")
        skip = begin * self.width % 8
        low_bits = low_bits[skip : skip + (end - begin) * self.width].reshape(-1, self.width).astype(np.int64)
        return (high.astype(np.int64) << self.width) | (low_bits << np.arange(self.width)).sum(axis=1)
