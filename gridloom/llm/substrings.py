"""Repeated substrings of at least `length` bytes, by suffix order and longest-previous-factor arrays.

A suffix array over all texts doesn't fit a machine, so texts are first split into independent
problems that keep every repeat together:

1. Each window of the shorter length asked for (`passage` bytes) has an anchor: of the GRAM-byte
   strings inside it, the leftmost of the least hash. Equal windows have equal anchors at equal
   places. Neighbouring windows share theirs, so a text falls into runs of windows, one for about
   every (passage - GRAM) / 2 bytes.
2. Runs whose anchor occurs once repeat nothing and go. Runs whose whole context (from the first
   byte of the first window to `length` bytes after the beginning of the last) is the same are
   counted, not compared.
3. Different contexts of one anchor meet. Their suffixes are sorted to a depth of `length`. The
   previous and next smaller text positions in that order give each window's longest previous
   factor, and the same over mirrored positions its longest following one; what has either is
   repeated. Windows next to one another in that order with a common prefix of `passage` bytes
   are one passage, which is shared if it is in more than one text.
4. An anchor with over CROWD different contexts would make one task large. Its windows are counted
   by a 128-bit hash of their bytes instead, which spreads them over all tasks.
5. What repeats goes back to every occurrence of its context, and to the texts.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, swept, text_of
from .tokens import STEP, mix, pieces, portions

LENGTH = 400
#: Shared passages: so many bytes at least, and over so many whole words.
PASSAGE, WORDS = 240, 50
GRAM = 50
CROWD = 4096
SEGMENT = (1 << 20) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of contexts whose suffixes are sorted at once; neighbours in their order that are compared at once.
BATCH, ROWS = 1 << 19, 1 << 12
#: Suffixes that are sorted at once; bytes of texts and what is said of them that become Python's objects at once, and what one such saying takes.
SUFFIXES, PORTION, SAID = 1 << 18, 1 << 22, 500


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, b, np.uint64)
        powers[:1] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


class _Rolling:
    """Hashes of substrings of a segment of bytes, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, powers: tuple[np.ndarray, np.ndarray]):
        self.inverse = powers[1]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][: len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray | slice, b: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[at])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` numbers in a row, from running minima of blocks both ways."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _segments(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of bytes that together hold each window once, and which of their windows lie in one text."""
    total, lo = int(offsets[-1]), 0
    ends = offsets[1:]
    while lo + length <= total:
        hi = min(total, lo + SEGMENT)
        starts = np.arange(lo, hi - length + 1)
        yield lo, hi, starts + length <= ends[np.searchsorted(ends, starts, "right")]
        lo = hi - length + 1


def _runs(length: int, passage: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of windows of `passage` bytes with the same anchor; contexts reach `length` bytes beyond the last window's beginning, in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = min(GRAM, passage)
        powers, width = _powers(BASES[0], SEGMENT + length + 1), passage - gram + 1
        for batch in batches:
            ids, xs = batch.column("id").to_numpy(), batch.column("x").to_numpy()
            for first, last, data, offsets in pieces(batch.column("text")):
                for lo, hi, valid in _segments(offsets, passage):
                    if not valid.any():
                        continue
                    rolling = _Rolling(data[lo : hi + length - passage], powers)
                    n = hi - lo - gram + 1
                    grams = rolling.of(slice(0, n), slice(gram, n + gram), slice(0, n))
                    at = _least((grams & ~np.uint64(SEGMENT)) | np.arange(n, dtype=np.uint64), width) & np.uint64(SEGMENT)
                    starts = np.flatnonzero(valid)
                    anchor = at[starts]
                    new = np.ones(len(starts), bool)
                    new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1])
                    a = starts[new]
                    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
                    row = np.searchsorted(offsets, a + lo, "right") - 1
                    end = np.minimum(a + count - 1 + length, offsets[row + 1] - lo)
                    context = rolling.of(a, end, a) ^ mix((end - a).astype(np.uint64) * STEP + count.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[first:last][row], pa.int64()), pa.array(xs[first:last][row], pa.int64()), pa.array(a + lo - offsets[row], pa.int64()), pa.array(count, pa.int32()), pa.array(grams[anchor[new].astype(np.int64)].view(np.int64)), pa.array(context.view(np.int64))],
                        names=["id", "x", "start", "n", "anchor", "context"],
                    )

    return run


def _smaller(position: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller number, or -1: pointers jump over what is larger."""
    n = len(position)
    out = np.arange(-1, n - 1)
    held = np.append(position, -1)  # place -1 is smaller than all
    active = np.arange(n)
    while len(active):
        active = active[held[out[active]] > position[active]]
        out[active] = out[out[active]]
    return out


class Factors:
    """Suffix order of the windows of some contexts to a depth, and the longest factors that follow from it.

    A window is the suffix that begins there, to the depth or its context's end, which is less than
    all bytes. No byte of UTF-8 is 254 or 255, so that every byte can be moved up by one for it.
    """

    def __init__(self, contexts: list[bytes], length: int, windows: list[int] | None = None):
        """windows: of each context how many of its first places are asked for; else all with `length` bytes before its end."""
        sizes = np.array([len(c) for c in contexts])
        ends = np.cumsum(sizes)
        windows = sizes - length + 1 if windows is None else np.array(windows)
        width = -(-length // 8) * 8
        data = np.minimum(np.frombuffer(b"".join(contexts) + bytes(width), np.uint8), 254) + np.uint8(1)
        starts = np.concatenate([np.arange(e - n, e - n + k) for e, n, k in zip(ends, sizes, windows, strict=True)] or [np.zeros(0, np.int64)])
        reach = np.minimum(length, np.repeat(ends, windows) - starts)
        suffix = np.lib.stride_tricks.sliding_window_view(data, width)[starts]
        over = np.flatnonzero(reach < width)
        suffix[over] *= np.arange(width) < reach[over, None]
        # Windows in suffix order, ties by position.
        self.order = np.argsort(suffix.view(f"S{width}").ravel(), kind="stable") if len(starts) else starts
        self.position = starts[self.order]
        self.common = np.zeros(max(0, len(starts) - 1), np.int64)
        for lo in range(0, len(self.common), ROWS):
            near = suffix[self.order[lo : lo + ROWS + 1]].view(np.uint64)
            off = near[1:] ^ near[:-1]
            place = (off != 0).argmax(axis=1)
            first = off[np.arange(len(off)), place]
            same = place * 8 + (first[:, None].view(np.uint8) != 0).argmax(axis=1)
            self.common[lo : lo + ROWS] = np.where(first == 0, reach[self.order[lo : lo + len(off)]], same)
        # Least common prefix of 1, 2, 4 ... neighbours from each place on.
        self.least = [self.common]
        while (step := 1 << (len(self.least) - 1)) * 2 <= len(self.common):
            self.least.append(np.minimum(self.least[-1][:-step], self.least[-1][step:]))

    def _prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the windows at places a < b of the order."""
        out, level = np.zeros(len(a), np.int64), np.frexp(b - a)[1] - 1
        for k, least in enumerate(self.least):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(least[a[at]], least[b[at] - (1 << k)])
        return out

    def _at_starts(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.order] = values
        return out

    def _longest(self, position: np.ndarray) -> np.ndarray:
        """Of each window, in suffix order, the longest common prefix with one of a smaller position: one of the two nearest in that order."""
        here = np.arange(len(position))
        before = _smaller(position)
        after = len(position) - 1 - _smaller(position[::-1])[::-1]
        out = np.zeros(len(position), np.int64)
        for a, b, has in ((before, here, before >= 0), (here, after, after < len(position))):
            out[has] = np.maximum(out[has], self._prefix(a[has], b[has]))
        return out

    def previous(self) -> np.ndarray:
        """Of each window, in text order, the longest factor that begins earlier."""
        return self._at_starts(self._longest(self.position))

    def following(self) -> np.ndarray:
        """Of each window, in text order, the longest factor that begins later: the previous one of mirrored positions."""
        return self._at_starts(self._longest(self.position.max(initial=0) - self.position))

    def shared(self, least: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each window, in text order, whether its first `least` bytes are in more than one text; lo and hi: of each window, in text order, the least and greatest text that has its context."""
        n = len(self.position)
        if not n:
            return np.zeros(0, bool)
        new = np.ones(n, bool)
        new[1:] = self.common < least
        first = np.flatnonzero(new)
        many = np.minimum.reduceat(lo[self.order], first) != np.maximum.reduceat(hi[self.order], first)
        return self._at_starts(np.repeat(many, np.diff(np.append(first, n))))


def _intervals(flags: np.ndarray) -> list[dict[str, int]]:
    """Runs of true flags as first place and place after the last."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"lo": int(a), "hi": int(b)} for a, b in edge.reshape(-1, 2)]


SPANS = "array<struct<lo:int,hi:int>>"
FOUND = f"anchor long, context long, found {SPANS}, shared {SPANS}"
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _places(window: np.ndarray, gram: int, powers: tuple[np.ndarray, np.ndarray], anchor: int) -> int:
    """Where a window has its anchor."""
    n = len(window) - gram + 1
    return int((_Rolling(window, powers).of(slice(0, n), slice(gram, n + gram), slice(0, n)).view(np.int64) == anchor).argmax())


def _said(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Portions of a batch of texts and lists of what is said of them."""
    said = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in portions(sizes + SAID * said, PORTION):
        yield batch.slice(lo, hi - lo)


def _compared(length: int, passage: int, keep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by anchor, then by where their context first occurs."""

    gram = min(GRAM, passage)

    def flags(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        # A context reaches beyond its run, whose windows alone are asked for; the others belong to other runs.
        windows = [r[5] for r in rows]
        factors = Factors([r[2] for r in rows], length, windows)
        longest = factors.previous() if keep == "first" else np.maximum(factors.previous(), factors.following())
        return longest >= length, factors.shared(passage, *(np.repeat(np.array([r[k] for r in rows], np.int64), windows) for k in (3, 4)))

    def banded(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Of one anchor's rows: windows that share `passage` bytes have the anchor at the same place, so those of a few places are compared at a time."""
        powers, windows = _powers(BASES[0], SEGMENT + length + 1), np.array([r[5] for r in rows])
        # The anchor's place in a context's first window, which is as many bytes less in each later one.
        places = np.array([_places(np.frombuffer(r[2], np.uint8)[:passage], gram, powers, r[0]) for r in rows])
        begin = np.cumsum(windows) - windows
        out, width = (np.zeros(int(windows.sum()), bool), np.zeros(int(windows.sum()), bool)), passage - gram + 1
        step = max(1, width * SUFFIXES // max(1, int(windows.sum())))
        for place in range(0, width, step):
            lo, hi = np.maximum(places - place - step + 1, 0), np.minimum(places - place + 1, windows)
            some = np.flatnonzero(lo < hi)
            if not len(some):
                continue
            at = np.concatenate([np.arange(begin[k] + lo[k], begin[k] + hi[k]) for k in some])
            for all_, part in zip(out, flags([(*rows[k][:2], rows[k][2][lo[k] : hi[k] - 1 + length], *rows[k][3:5], int(hi[k] - lo[k])) for k in some]), strict=True):
                all_[at] = part
        return out

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        windows = [r[5] for r in rows]
        if sum(windows) <= SUFFIXES:
            both = flags(rows)
        else:
            both = (np.concatenate(x) for x in zip(*(banded(list(g)) for _, g in itertools.groupby(rows, lambda r: r[0])), strict=True))
        cuts = np.cumsum(windows)[:-1]
        found, both = ([_intervals(x) for x in np.split(marks, cuts)] for marks in both)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(found, _SPANS), pa.array(both, _SPANS)], names=["anchor", "context", "found", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "bytes", "lo", "hi", "n")), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue  # a row that repeats an id and its text
                if size > BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield solve(held)

    return run


WANTED = "anchor long, context long, crowd boolean, id long, x long, start long, n int, lo long, hi long, bytes binary"


def _cut_out(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of each wanted context of a text."""
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in WANTED.split(", ")]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _said(whole, "wanted")):
            out, size = [], 0
            for text, wanted in zip(batch.column("text").cast(pa.large_binary()), batch.column("wanted").to_pylist(), strict=True):
                text = text.as_py()
                for w in wanted:
                    out.append((*(w[c] for c in names[:-1]), text[w["start"] : w["start"] + w["n"] - 1 + length]))
                    size += len(out[-1][-1])
                if size > 1 << 23:
                    yield rows(out)
                    out, size = [], 0
            yield rows(out)

    return run


def _hashed(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each window of `length` bytes of a run, as far as its context reaches: its place in the run and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [_powers(b, SEGMENT + length + 1) for b in BASES]
        # A window takes some 200 bytes.
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in portions(whole.column("n").to_numpy().astype(np.int64) * 200, PORTION)):
            out = [[], [], [], []]
            for k, (raw, windows) in enumerate(zip(batch.column("bytes").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                data = np.frombuffer(raw, np.uint8)
                n = max(0, min(windows, len(data) - length + 1))
                hashes = [_Rolling(data, p).of(slice(0, n), slice(length, n + length), slice(0, n)).view(np.int64) for p in powers]
                for column, values in zip(out, (np.full(n, k), np.arange(n), *hashes), strict=True):
                    column.append(values)
            k, place, one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            rest = [batch.column(c).take(pa.array(k)) for c in ("anchor", "context", "id", "x", "start", "lo", "hi")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(place, pa.int32()), pa.array(one), pa.array(two)], names=["anchor", "context", "id", "x", "start", "lo", "hi", "place", "one", "two"])

    return run


def _merged(places: list[dict], width: int, end: int) -> list[list[int]]:
    """Windows lo..hi as spans of bytes, those that touch as one; what would reach beyond the end isn't a window."""
    spans: list[list[int]] = []
    for lo, hi in sorted((p["lo"], min(p["hi"], end - width + 1)) for p in places):
        if hi <= lo:
            continue
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + width - 1)
        else:
            spans.append([lo, hi + width - 1])
    return spans


def _whole_words(text: bytes, lo: int, hi: int) -> int:
    """Words that lie in text[lo:hi] as a whole."""
    part = text[lo:hi]
    cut_first = lo > 0 and not text[lo - 1 : lo].isspace() and not part[:1].isspace()
    cut_last = hi < len(text) and not text[hi : hi + 1].isspace() and not part[-1:].isspace()
    return max(0, len(part.split()) - cut_first - cut_last)


def _result(length: int, passage: int, words: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), spans_of, spans_of, pa.binary())
        for batch in (part for all_ in batches for part in _said(all_, "marks")):
            out = []
            for text, places in zip(batch.column("text").cast(pa.large_binary()), batch.column("marks").to_pylist(), strict=True):
                text = text.as_py()
                spans, same = (_merged([p for p in places or () if p["passage"] == kind], width, len(text)) for kind, width in ((False, length), (True, passage)))
                same = [x for x in same if _whole_words(text, *x) > words]
                rest, at = [], 0
                for lo, hi in spans:
                    rest.append(text[at:lo])
                    at = hi
                rest = b"".join([*rest, text[at:]])
                as_rows = [[{"lo": a, "hi": b} for a, b in x] for x in (spans, same)]
                out.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest(), len(same), *as_rows, rest if whole else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: 8 if whole else 7]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "removed", "passages", "rest"][: 9 if whole else 8])

    return run


def repeated_substrings(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "none", crowd: int = CROWD, rest: bool = False, passage: int = PASSAGE, words: int = WORDS
) -> DataFrame:
    """One row for each row of df: id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, removed, passages (spans of bytes).

    Removes each byte covered by a string of `length` bytes that also begins elsewhere, in the same
    text or another; matches never cross texts. keep="first" spares a string's first occurrence, by
    id (null first) and place. passages: the longest stretches that strings of `passage` bytes
    (`length` at most) which another text has too cover, with over `words` whole words; they are
    reported and stay. rest=True adds the remaining bytes. A null text counts as empty. Rows are
    texts of their own, also those that repeat an id or have none; rows that repeat an id and its
    text repeat all of it, but count as one text for passages and as one place for keep="first". An empty table gives an empty
    result. Other columns are not read.

    Contexts of one anchor count as equal by a hash of 64 bits: two of n different ones share it
    with a chance of n * n / 2 ** 65. A row is found again by its id and a hash of its text.
    """
    if not 0 < passage <= length:
        raise ValueError("a passage has between one and `length` bytes")
    none = -(2**63)
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("x"), "text")
    runs = texts.mapInArrow(_runs(length, passage), "id long, x long, start long, n int, anchor long, context long")
    anchors = swept(cut(runs.groupBy("anchor").count().filter("count > 1").select("anchor")))
    runs = swept(cut(runs.join(anchors, "anchor", "left_semi"), anchors))
    who = F.xxhash64("id", "x")
    contexts = cut(runs.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(who).alias("lo"), F.max(who).alias("hi"), F.min(F.struct("id", "x", "start", "n")).alias("first")))
    kinds = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")

    want = contexts.join(kinds, "anchor").select(F.struct("anchor", "context", (F.col("kinds") > crowd).alias("crowd"), "first.id", "first.x", "first.start", "first.n", "lo", "hi").alias("w"))
    wanted = want.groupBy("w.id", "w.x").agg(F.collect_list("w").alias("wanted"))  # bounded by the text
    pieces_of = swept(cut(texts.join(wanted, ["id", "x"]).select("text", "wanted").mapInArrow(_cut_out(length), WANTED)))
    usual = pieces_of.filter("NOT crowd").repartition("anchor").sortWithinPartitions("anchor", "id", "x", "start", "context")
    found = usual.select("anchor", "context", "bytes", "lo", "hi", "n").mapInArrow(_compared(length, passage, keep), FOUND)

    def counted(width: int, passages: bool) -> DataFrame:
        """Of crowded anchors the windows of `width` bytes that are elsewhere, or in several texts, by context."""
        windows = pieces_of.filter("crowd").mapInArrow(_hashed(width), "anchor long, context long, id long, x long, start long, lo long, hi long, place int, one long, two long")
        place = F.struct("id", "x", F.col("start") + F.col("place"))
        met = windows.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("lo").alias("least"), F.max("hi").alias("most"))
        met = met.filter("least != most" if passages else "first != last").select("one", "two", "first")
        met = windows.join(met, ["one", "two"])
        if keep == "first" and not passages:
            met = met.filter(place != F.col("first"))
        spans = F.transform(F.array_sort(F.collect_set("place")), lambda p: F.struct(p.alias("lo"), (p + 1).alias("hi")))
        return met.groupBy("anchor", "context").agg(spans.alias("shared" if passages else "found"))

    crowded = counted(length, False).join(counted(passage, True), ["anchor", "context"], "full")
    found = found.unionByName(crowded.select("anchor", "context", F.col("found").cast(SPANS).alias("found"), F.col("shared").cast(SPANS).alias("shared")))
    found = swept(cut(found.filter("size(found) > 0 OR size(shared) > 0"), pieces_of))

    # What is to be said of a context's occurrences, of most nothing: a table of its own, so that a hot context's runs can be split.
    told = contexts.select("anchor", "context", "copies", "lo", "hi", "first").join(found, ["anchor", "context"], "left").filter("copies > 1 OR found IS NOT NULL OR shared IS NOT NULL")
    marked = runs.join(cut(told), ["anchor", "context"])
    copy = F.col("copies") > 1 if keep == "none" else F.struct("id", "x", "start", "n") != F.col("first")
    everything = F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")))

    def at(spans: Column, passages: bool) -> Column:
        return F.transform(F.coalesce(spans, F.array().cast(SPANS)), lambda f: F.struct((F.col("start") + f["lo"]).alias("lo"), (F.col("start") + f["hi"]).alias("hi"), F.lit(passages).alias("passage")))

    marks = F.concat(at(F.when(copy, everything).otherwise(F.col("found")), False), at(F.when(F.col("lo") != F.col("hi"), everything).otherwise(F.col("shared")), True))
    marked = marked.select("id", "x", F.explode(marks).alias("m")).groupBy("id", "x").agg(F.collect_set("m").alias("marks"))  # bounded by the text
    out = texts.join(marked, ["id", "x"], "left").select("id", "text", "marks")
    spans = "array<struct<lo:long,hi:long>>"
    schema = f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, removed {spans}, passages {spans}"
    out = out.mapInArrow(_result(length, passage, words, rest), schema + (", rest binary" if rest else ""))
    return out.withColumn("id", F.nullif("id", F.lit(none))).withColumnRenamed("id", id_col)
