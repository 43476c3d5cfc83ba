"""Monotone sequences in about 2 + log2(universe / n) bits a number, read where they lie.

A number's low bits are packed side by side; its high part is in a bit vector that has, for each
high part in turn, a one for each number with that part and then a zero. All reads take arrays.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

ONE = np.uint64(1)
#: Numbers that are encoded at once, a multiple of 8: each has a byte for every low bit meanwhile.
PORTION = 1 << 16
#: Numbers of 64 bits whose bytes are all the same.
EACH = {x: np.uint64(x * 0x0101010101010101) for x in (0x01, 0x0F, 0x33, 0x55, 0x80)}
#: Of each byte, at 8 * byte + k, the place of its k-th one.
ONES = np.array([p[k] if k < len(p) else 0 for b in range(256) for p in ([i for i in range(8) if b >> i & 1],) for k in range(8)], np.uint8)


def select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one of each word, which has more than k: by counts of its bytes' ones, summed up within the word."""
    count = words - ((words >> ONE) & EACH[0x55])
    count = (count & EACH[0x33]) + ((count >> np.uint64(2)) & EACH[0x33])
    count = ((count + (count >> np.uint64(4))) & EACH[0x0F]) * EACH[0x01]
    # A byte's leading bit stays where the ones up to it are k at most; those bytes lie before the one asked for.
    k = k.astype(np.uint64)
    passed = ((((k * EACH[0x01]) | EACH[0x80]) - count) & EACH[0x80]) >> np.uint64(7)
    at = ((passed * EACH[0x01]) >> np.uint64(56)) << np.uint64(3)
    before = ((count << np.uint64(8)) >> at) & np.uint64(0xFF)
    return at.astype(np.int64) + ONES[(((words >> at) & np.uint64(0xFF)) << np.uint64(3)) + k - before]


def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
    """values: sorted, below universe. Head, packed low bits, high bits, ones before each word of high bits."""
    n = len(values)
    low = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
    marks = np.zeros(-(-(n + (universe >> low) + 2) // 64) * 64, np.uint8)
    packed = []
    for i in range(0, n, PORTION):
        part = values[i : i + PORTION].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, count=low, bitorder="little")
        packed.append(np.packbits(bits.ravel(), bitorder="little"))
        marks[(part >> np.uint64(low)).astype(np.int64) + np.arange(i, i + len(part))] = 1
    packed = np.concatenate([*packed, np.zeros(8, np.uint8)])
    counts = marks.reshape(-1, 64).sum(axis=1, dtype=np.int64)
    return [np.array([n, low], np.int64), packed, np.packbits(marks, bitorder="little"), np.concatenate([[0], np.cumsum(counts)])]


class EliasFano:
    def __init__(self, parts: list[np.ndarray]):
        (self.n, self.low), packed, self.high, self.ones = (int(parts[0][0]), int(parts[0][1])), parts[1], parts[2].view("<u8"), parts[3]
        self.windows = np.ndarray((len(packed) - 7,), "<u8", packed, strides=(1,))
        self.mask = np.uint64((1 << self.low) - 1)
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        return (self.windows[at >> 3] >> (at & 7).astype(np.uint64)) & self.mask

    def _select(self, k: np.ndarray, before: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one, or zero, of the high bits."""
        word = np.searchsorted(before, k, "right") - 1
        high = self.high[word]
        return word * 64 + select(high if one else ~high, k - before[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, self.ones, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the place of the first number that is not less, and whether it is x."""
        x = x.astype(np.uint64)
        high, low = (x >> np.uint64(self.low)).astype(np.int64), x & self.mask
        end = self._select(high, self.zeros, False) - high
        at = np.zeros(len(x), np.int64)
        later = np.flatnonzero(high > 0)
        at[later] = self._select(high[later] - 1, self.zeros, False) + 1 - high[later]
        # Halving: a context with many successors has many numbers of one high part.
        top = end.copy()
        active = np.flatnonzero(at < top)
        while len(active):
            middle = (at[active] + top[active]) >> 1
            less = self._low(middle) < low[active]
            at[active[less]] = middle[less] + 1
            top[active[~less]] = middle[~less]
            active = active[at[active] < top[active]]
        found = at < end
        found[found] = self._low(at[found]) == low[found]
        return at, found


def mapped(levels: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Writes the levels to a file of the worker's own, maps it and unlinks it: pages come and go with use, nothing stays."""
    fd, path = tempfile.mkstemp(prefix="trie-")
    try:
        with os.fdopen(fd, "r+b") as file:
            places, at = [], 0
            for level in levels:
                places.append([])
                for part in level:
                    raw = np.ascontiguousarray(part).tobytes()
                    places[-1].append((part.dtype, len(part), at))
                    file.write(raw + bytes(-len(raw) % 8))
                    at += len(raw) + -len(raw) % 8
            file.write(bytes(8))
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    finally:
        os.unlink(path)
    return [[np.frombuffer(view, dtype, n, at) for dtype, n, at in level] for level in places]
