"""Words, hashes and shingles of many texts at once, on the UTF-8 bytes of an Arrow batch.

The contracts' white space is ASCII, so words can be cut in the bytes. Word hashes have 64 bits:
two of n words share one with a chance of about n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
STEP = np.array(0x9E3779B97F4A7C15, np.uint64)
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def pieces(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a text column into runs of rows of about `limit` bytes: first row, row after the last, bytes, offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def portions(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs whose sizes sum up to the limit at most, one row at least: first row, row after the last."""
    sums, lo = np.cumsum(sizes), 0
    while lo < len(sums):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, all spans a byte further at each step; long ones one by one."""
    sizes = ends - starts
    hashes = sizes.astype(np.uint64) * STEP
    short = np.flatnonzero(sizes <= LONG)
    short = short[np.argsort(-sizes[short].astype(np.int8), kind="stable")]
    falling = -sizes[short]
    for k in range(int(sizes[short].max(initial=0))):
        active = short[: np.searchsorted(falling, -k)]
        hashes[active] = (hashes[active] ^ data[starts[active] + k]) * STEP
        hashes[active] ^= hashes[active] >> np.uint64(29)
    for i in np.flatnonzero(sizes > LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return mix(hashes)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words begin among them (one entry more than rows)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = LOWER[data] if lower else data
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> list[np.ndarray]:
    """Each row's distinct shingles as sorted hashes; fewer words than `width` make one shingle, no words none."""
    hashes, begin = words(data, offsets)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = mix(rolled ^ hashes[k : len(hashes) - width + 1 + k])
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        else:
            one = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                one = mix(one ^ h)
            out.append(one if b > a else one[:0])
    return out
