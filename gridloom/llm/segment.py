"""Distinct sampled segmentations of whole texts into the pieces of a SentencePiece vocabulary.

The lattice of a text has an edge wherever a piece matches, and for the bytes of characters that
are no piece a byte each. A segmentation's chance is in proportion to the product of its pieces'
chances. Pieces of a BPE vocabulary have ranks and no chances; Zipf's law makes the one the other.

A text falls apart wherever two bytes meet that no piece has side by side (before a space, mostly),
and equal parts have equal lattices, so that lattices are solved once for the distinct units of many
runs of texts, all new units of a length together. Sums over the prefixes of a unit give, at each place,
the chance of each piece that ends there; walking back by these draws a segmentation exactly.

Sampling without replacement (Gumbel top-k by perturbed A* search): the root of a text's search
tree, all of its segmentations, has a Gumbel number G. Walking down, each step's chosen piece keeps
its node's G; the pieces not chosen are together one more node, whose G is a Gumbel at the logarithm
of their chance, cut off at that of the node above. The open node of the greatest G has the next
sample: another piece at its step, and a fresh walk from there. A sample's inclusion score is
1 - exp(-exp(log chance - threshold)), the threshold being the greatest G that was left open.

Random numbers are hashes of a row's key, so they depend on neither batches nor tasks.
"""

from __future__ import annotations

import copy
import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import STEP, mix, pieces, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = 1
#: Chance of the piece of rank r is in proportion to 1 / (r + ZIPF) ** TEMPER.
ZIPF, TEMPER = 10.0, 1.0
SPACE = 0x20
MARK = "▁".encode()
FILTER = 20
#: Edges of lattices that a worker keeps, of 24 bytes each.
KEEP = 1 << 21


class Vocabulary:
    """Pieces as bytes, with the space for the library's mark, and what is needed to find them."""

    def __init__(self, path: str, temper: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.raw = [b""] * n
        normal = []
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:-1], 16)
                self.byte[b], self.raw[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.raw[i] = model.id_to_piece(i).encode().replace(MARK, b" ")
                normal.append(i)
        ranks = np.argsort(np.argsort([-model.get_score(i) for i in normal], kind="stable"), kind="stable")
        chance = 1 / (ranks + ZIPF) ** temper
        self.score = np.full(n, np.log(chance.min() / chance.sum()) - 1)
        self.score[normal] = np.log(chance / chance.sum())
        # Two bytes stay together if a piece, or a character, has them side by side.
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        for i in normal:
            b = np.frombuffer(self.raw[i], np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.single = {self.raw[i].decode() for i in normal if len(self.raw[i].decode()) == 1}
        self.longest = max(len(self.raw[i]) for i in normal)
        data = np.frombuffer(b"".join(self.raw[i] for i in normal), np.uint8)
        sizes = np.array([len(self.raw[i]) for i in normal])
        hashes = _rolled(data, np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(normal)[order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("pieces share a hash")
        self.likely = np.zeros(1 << FILTER, bool)
        self.likely[hashes >> np.uint64(64 - FILTER)] = True
        # Where the hashes of the same leading bits begin, and how many share theirs at most.
        count = np.bincount((hashes >> np.uint64(64 - FILTER)).astype(np.int64), minlength=1 << FILTER)
        self.begin, self.shared = (np.cumsum(count) - count).astype(np.int32), int(count.max(initial=0))
        self.sizes = np.array([len(r) for r in self.raw])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        at, out = self.begin[hashes >> np.uint64(64 - FILTER)], np.full(len(hashes), -1)
        for k in range(self.shared):
            near = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[near] == hashes
            out[hit] = self.ids[near[hit]]
        return out


def _longer(hashes: np.ndarray, data: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ data) * STEP
    return hashes ^ (hashes >> np.uint64(31))


def _rolled(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.full(len(starts), STEP)
    for k in range(int(sizes.max(initial=0))):
        on = sizes > k
        out[on] = _longer(out[on], data[starts[on] + k])
    return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, temper: float) -> Vocabulary:
    return Vocabulary(path, temper)


class Lattices:
    """Of distinct units: the edges that end at each place, with chances that sum to one there."""

    def __init__(self, vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        # Units of a size are numbered together: place p of the i-th of m has number base + p * m + i.
        self.sizes, self.first, self.last = sizes, np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        ends, froms, ids, chances, base = [], [], [], [], 0
        for size in np.unique(sizes):
            units = np.flatnonzero(sizes == size)
            for some in np.array_split(units, max(1, len(units) * int(size) >> 20)):
                n = len(some)
                self.first[some], self.last[some] = base + np.arange(n), base + int(size) * n + np.arange(n)
                end, start, piece, chance = self._solved(vocab, data, starts[some], int(size))
                for column, values in zip((ends, froms, ids, chances), (end + base, start + base, piece, chance), strict=True):
                    column.append(values)
                base += (int(size) + 1) * n
        end = np.concatenate(ends or [np.zeros(0, np.int64)])
        self.start = np.concatenate(froms or [end])
        self.id = np.concatenate(ids or [end])
        self.chance = np.concatenate(chances or [np.zeros(0)])
        self.log = np.log(self.chance)
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=base))])
        self.start, self.id, self.edges = (x.astype(np.int32) for x in (self.start, self.id, self.edges))

    def and_more(self, other: Lattices) -> Lattices:
        """These and, behind them, another's."""
        out, places = copy.copy(self), len(self.edges) - 1
        out.first, out.last, out.start = (np.concatenate([a, b + places]) for a, b in ((self.first, other.first), (self.last, other.last), (self.start, other.start)))
        out.start = out.start.astype(np.int32)
        out.id, out.chance, out.log, out.sizes = (np.concatenate(x) for x in ((self.id, other.id), (self.chance, other.chance), (self.log, other.log), (self.sizes, other.sizes)))
        out.edges = np.concatenate([self.edges, other.edges[1:] + self.edges[-1]]).astype(np.int32)
        return out

    def only(self, units: np.ndarray) -> Lattices:
        """Those of some units, numbered as these are given."""
        # A unit's places are as far apart as there were units of its size.
        steps = self.sizes[units] + 1
        apart = (self.last[units] - self.first[units]) // np.maximum(self.sizes[units], 1)
        stay = np.zeros(len(self.edges) - 1, bool)
        stay[np.repeat(self.first[units], steps) + np.repeat(apart, steps) * (np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps))] = True
        new, count = np.cumsum(stay) - 1, np.diff(self.edges)
        edge = np.repeat(stay, count)
        out = copy.copy(self)
        out.sizes, out.first, out.last, out.start = self.sizes[units], new[self.first[units]], new[self.last[units]], new[self.start[edge]]
        out.id, out.chance, out.log, out.edges = self.id[edge], self.chance[edge], self.log[edge], np.concatenate([[0], np.cumsum(count[stay])]).astype(np.int32)
        out.start = out.start.astype(np.int32)
        return out

    @staticmethod
    def _solved(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Edges by the place they end at and unit: end, start, piece, chance."""
        n = len(starts)
        grid = data[starts[:, None] + np.arange(size)]
        hashes = np.full((n, size), STEP)
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # length, unit, start, piece
        covered = np.zeros((n, size), bool)
        width = np.where(grid < 0x80, 1, np.where(grid < 0xE0, 2, np.where(grid < 0xF0, 3, 4)))
        for length in range(1, min(size, vocab.longest) + 1):
            hashes = _longer(hashes[:, : size - length + 1], grid[:, length - 1 :])
            unit, start = np.nonzero(vocab.likely[hashes >> np.uint64(64 - FILTER)])
            piece = vocab.find(hashes[unit, start])
            hit = piece >= 0
            unit, start, piece = unit[hit], start[hit], piece[hit]
            found.append((length, unit, start, piece))
            whole = width[unit, start] == length
            for k in range(length if length <= 4 else 0):
                covered[unit[whole], start[whole] + k] = True
        unit, start = np.nonzero(~covered)
        found.append((1, unit, start, vocab.byte[grid[unit, start]]))
        unit = np.concatenate([f[1] for f in found])
        start = np.concatenate([f[2] for f in found])
        piece = np.concatenate([f[3] for f in found])
        end = start + np.concatenate([np.full(len(f[1]), f[0]) for f in found])
        end = end * n + unit
        order = np.argsort(end, kind="stable")  # by length, whatever else is solved with them
        unit, start, piece, end = unit[order], start[order] * n + unit[order], piece[order], end[order]
        score, sums = vocab.score[piece], np.full((size + 1) * n, -np.inf)
        sums[:n] = 0
        chance = np.empty(len(unit))
        cuts = np.searchsorted(end, np.arange(1, size + 2) * n)
        for place in range(size):
            at = slice(cuts[place], cuts[place + 1])
            goal, x = end[at], sums[start[at]] + score[at]
            if not len(goal):
                continue
            runs = np.flatnonzero(np.diff(goal, prepend=-1))
            each = np.diff(np.append(runs, len(goal)))
            top = np.maximum.reduceat(x, runs)
            top[np.isinf(top)] = 0
            weight = np.exp(x - np.repeat(top, each))
            total = np.add.reduceat(weight, runs)
            with np.errstate(divide="ignore"):
                sums[goal[runs]] = np.log(total) + top
            chance[at] = weight / np.repeat(np.where(total > 0, total, 1), each)
        live = chance > 0
        return end[live], start[live], piece[live], chance[live]


class Kept:
    """Lattices of the units met so far, by the hash of their bytes, so that a unit is solved once for many runs of texts.

    Beyond `most` edges only those of units met in several runs stay; if they alone have over half of that, all go.
    """

    def __init__(self, vocab: Vocabulary, most: int = KEEP):
        self.vocab, self.most = vocab, most
        self._drop()

    def _drop(self) -> None:
        none = np.zeros(0, np.int64)
        self.hashes, self.rank, self.often = np.zeros(0, np.uint64), none, np.zeros(0, bool)
        self.lattices = Lattices(self.vocab, np.zeros(0, np.uint8), none, none)

    def _trim(self) -> None:
        stay = self.often[self.rank]
        self.lattices = self.lattices.only(self.rank[stay])
        self.hashes = self.hashes[stay]
        self.rank, self.often = np.arange(len(self.hashes)), np.zeros(len(self.hashes), bool)
        if 2 * len(self.lattices.start) > self.most:
            self._drop()

    def of(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[Lattices, np.ndarray]:
        """Lattices, and which of theirs each unit has; the hashes are sorted and differ."""
        if len(self.lattices.start) > self.most:
            self._trim()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = np.flatnonzero(at < len(self.hashes))
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        rank = np.empty(len(hashes), np.int64)
        rank[known] = self.rank[at[known]]
        self.often[rank[known]] = True
        if len(new):
            rank[new] = len(self.rank) + np.arange(len(new))
            self.lattices = self.lattices.and_more(Lattices(self.vocab, data, starts[new], sizes[new]))
            self.hashes, self.rank = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.rank, at[new], rank[new])
            self.often = np.append(self.often, np.zeros(len(new), bool))
        return self.lattices, rank


@functools.lru_cache(maxsize=2)
def kept(path: str, temper: float) -> Kept:
    """A worker's, for all batches that it gets."""
    return Kept(vocabulary(path, temper))


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Walk:
    """Edges in the order of walking: by token, and within it from its end to its start."""

    token: np.ndarray
    edge: np.ndarray


def walk(lattices: Lattices, unit: np.ndarray, place: np.ndarray, key: np.ndarray) -> Walk:
    """Walks each token from a place of its unit back to the start, by random numbers from its key."""
    tokens, edges, active, at, step = [], [], np.arange(len(unit)), place.copy(), 0
    goal = lattices.first[unit]
    active = active[at > goal]
    while len(active):
        step += 1
        here = at[active]
        u = _uniform(key[active] + np.uint64(step) * STEP)
        edge, last = lattices.edges[here].copy(), lattices.edges[here + 1] - 1
        seeking = np.flatnonzero((u > lattices.chance[edge]) & (edge < last))
        while len(seeking):
            u[seeking] -= lattices.chance[edge[seeking]]
            edge[seeking] += 1
            seeking = seeking[(u[seeking] > lattices.chance[edge[seeking]]) & (edge[seeking] < last[seeking])]
        tokens.append(active)
        edges.append(edge)
        at[active] = lattices.start[edge]
        active = active[at[active] > goal[active]]
    count = np.zeros(len(unit), np.int64)
    for x in tokens:
        count[x] += 1
    begin = np.cumsum(count) - count
    edge = np.empty(int(count.sum()), np.int64)
    for done, (x, e) in enumerate(zip(tokens, edges, strict=True)):
        edge[begin[x] + done] = e
    return Walk(np.repeat(np.arange(len(unit)), count), edge)


def _cut_off(location: np.ndarray, limit: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at a location, given that they are below a limit."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.log(np.exp(np.minimum(location - limit, 700)) - np.log(u)))


@dataclass
class Path:
    """One sample of a text: tokens and edges of its steps, log chances before them, and what is open beside each."""

    token: np.ndarray
    edge: np.ndarray
    before: np.ndarray
    open: np.ndarray
    g: float
    log: float
    used: dict[int, set[int]]


class Texts:
    """A run of texts, cut into tokens that are units of a lattice."""

    def __init__(self, kept: Kept, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray):
        self.vocab = vocab = kept.vocab
        sizes = np.diff(offsets)
        # One space goes before each text that isn't empty; the library's mark in a text is a space.
        lead = (sizes > 0).astype(np.int64)
        new = np.concatenate([[0], np.cumsum(sizes + lead)])
        flat = np.empty(int(new[-1]), np.uint8)
        inside = np.ones(len(flat), bool)
        inside[new[:-1][sizes > 0]] = False
        flat[inside], flat[~inside] = data, SPACE
        begin = ~vocab.joined[np.append(np.uint8(0), flat[:-1]), flat]
        begin[new[:-1][sizes > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(flat)) if len(starts) else starts
        self.bounds = np.searchsorted(starts, new)
        hashes = span_hashes(flat, starts, ends)
        hashes, index, unit = np.unique(hashes, return_index=True, return_inverse=True)
        self.lattices, rank = kept.of(hashes, flat, starts[index], (ends - starts)[index])
        self.unit = rank[unit]
        self.places = self.lattices.last[self.unit]
        self.row = np.repeat(np.arange(len(sizes)), np.diff(self.bounds))
        self.keys = keys

    def _key(self, token: np.ndarray, round_: int) -> np.ndarray:
        rank = (token - self.bounds[self.row[token]]).astype(np.uint64)
        return mix(mix(self.keys[self.row[token]] + np.uint64(round_)) + rank * np.uint64(0xD6E8FEB86659FD93))

    def _opened(self, rows: np.ndarray, walked: Walk, cut: np.ndarray, before: np.ndarray, limit: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the rows whose steps lie between the cuts: log chances before each step, open numbers beside it, log chance of all."""
        size = np.diff(cut)
        log = self.lattices.log[walked.edge]
        sums = np.concatenate([[0.0], np.cumsum(log)])
        each = np.repeat(np.arange(len(rows)), size)
        logs = sums[:-1] + (before - sums[cut[:-1]])[each]
        split = np.flatnonzero(log < -1e-12)  # steps that had a choice
        u = _uniform(mix(self.keys[rows] + np.uint64(7919 * round_))[each[split]] + (split - cut[:-1][each[split]]).astype(np.uint64) * STEP)
        open_ = np.full(len(log), -np.inf)
        open_[split] = _cut_off(logs[split] + np.log(np.maximum(1 - self.lattices.chance[walked.edge[split]], 1e-300)), limit[each[split]], u)
        return logs, open_, before + sums[cut[1:]] - sums[cut[:-1]]

    def sampled(self, k: int) -> list[tuple[list[Path], float]]:
        """For each text its k samples, or all there are, by falling G; and the threshold."""
        rows = len(self.bounds) - 1
        walked = walk(self.lattices, self.unit, self.places, self._key(np.arange(len(self.unit)), 1))
        cut = np.searchsorted(walked.token, self.bounds)
        roots = -np.log(-np.log(_uniform(mix(self.keys + np.uint64(17)))))
        paths: list[list[Path]] = []
        before, open_, log = self._opened(np.arange(rows), walked, cut, np.zeros(rows), roots, 1)
        for r in range(rows):
            part = slice(cut[r], cut[r + 1])
            paths.append([Path(walked.token[part], walked.edge[part], before[part], open_[part], float(roots[r]), float(log[r]), {})])
        for round_ in range(2, k + 1):
            todo, tokens, places, locations = [], [], [], []
            choice, narrow = (_uniform(mix(self.keys + np.uint64(x * round_))) for x in (104729, 1299709))
            for r in range(rows):
                if len(paths[r]) == round_ - 1 and (best := self._best(paths[r])):
                    path, s, g = best
                    edge, location = self._other(path, s, choice[r])
                    t = int(path.token[s])
                    rest = np.arange(t + 1, self.bounds[r + 1])
                    todo.append((r, path, s, g, edge, 1 + len(rest)))
                    tokens += [np.array([t]), rest]
                    places += [self.lattices.start[[edge]], self.places[rest]]
                    locations.append(location)
            if not todo:
                break
            opened = _cut_off(np.array(locations), np.array([x[3] for x in todo]), narrow[[x[0] for x in todo]])
            for (_, path, s, *_), g in zip(todo, opened, strict=True):
                path.open[s] = g
            token = np.concatenate(tokens)
            walked = walk(self.lattices, self.unit[token], np.concatenate(places), self._key(token, round_))
            cut = np.searchsorted(walked.token, np.cumsum([0, *(x[5] for x in todo)]))
            start = np.array([path.before[s] + self.lattices.log[edge] for _, path, s, _, edge, _ in todo])
            before, open_, log = self._opened(np.array([x[0] for x in todo]), walked, cut, start, np.array([x[3] for x in todo]), round_)
            for i, (r, path, s, g, edge, _) in enumerate(todo):
                part = slice(cut[i], cut[i + 1])
                paths[r].append(Path(
                    np.concatenate([path.token[: s + 1], token[walked.token[part]]]), np.concatenate([path.edge[:s], [edge], walked.edge[part]]),
                    np.concatenate([path.before[: s + 1], before[part]]), np.concatenate([np.full(s + 1, -np.inf), open_[part]]), g, float(log[i]), {},
                ))
        return [(p, best[2] if (best := self._best(p)) else -np.inf) for p in paths]

    @staticmethod
    def _best(paths: list[Path]) -> tuple[Path, int, float] | None:
        tops = [(float(p.open[s]), i, s) for i, p in enumerate(paths) if len(p.open) for s in (int(p.open.argmax()),)]
        g, i, s = max(tops, default=(-np.inf, 0, 0))
        return None if g == -np.inf else (paths[i], s, g)

    def _other(self, path: Path, s: int, u: float) -> tuple[int, float]:
        """Another edge at a step, which no sample has taken from there, and the log chance of what is left beside it."""
        edges, used = self.lattices.edges, path.used.setdefault(s, {int(path.edge[s])})
        place = int(np.searchsorted(edges, edges.dtype.type(path.edge[s]), "right") - 1)  # of the same type, or all edges would be copied
        lo, hi = int(edges[place]), int(edges[place + 1])
        options = np.array([e for e in range(lo, hi) if e not in used], np.int64)
        chance = self.lattices.chance[options]
        at = min(int(chance.cumsum().searchsorted(u * chance.sum())), len(options) - 1)
        used.add(int(options[at]))
        rest = np.delete(chance, at)
        return int(options[at]), path.before[s] + (np.log(rest.sum()) if len(rest) else -np.inf)

    def ids(self, paths: list[Path]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of some paths from the text's first to its last, each token's steps turned around, and where each path's begin."""
        if not paths:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        token, edge, bounds = np.concatenate([p.token for p in paths]), np.concatenate([p.edge for p in paths]), np.cumsum([0, *(len(p.edge) for p in paths)])
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        new[bounds[:-1][bounds[:-1] < len(token)]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(token)) - 1
        return self.lattices.id[edge[np.repeat(first + last, last + 1 - first) - np.arange(len(token))]], bounds


def _joined(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    return _all_joined(vocab, ids, np.array([0, len(ids)]))[0]


def _all_joined(vocab: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """What the pieces between the bounds decode to, without the space before it."""
    sizes = vocab.sizes[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(vocab.starts[ids] - ends[:-1], sizes) + np.arange(int(ends[-1]))
    data, cuts = vocab.data[at].tobytes(), ends[bounds].tolist()
    return [data[a + 1 : b] for a, b in itertools.pairwise(cuts)]


SAMPLE = pa.struct([("ids", pa.list_(pa.int32())), ("log_chance", pa.float64()), ("g", pa.float64()), ("inclusion", pa.float64()), ("decoded_sha256", pa.string())])


def _encode(k: int, seed: int, path: str, temper: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, solved = vocabulary(path, temper), kept(path, temper)
        for batch in batches:
            keys = mix(batch.column("key").to_numpy().view(np.uint64) + np.uint64(seed))
            for lo, hi, data, offsets in pieces(batch.column("text"), 3 << 19):
                texts = Texts(solved, data, offsets, keys[lo:hi])
                found = texts.sampled(k)
                paths = [p for of, _ in found for p in of]
                counts = np.cumsum([0, *(len(of) for of, _ in found)])
                thresholds = np.repeat(np.array([x for _, x in found], float), np.diff(counts))
                logs, gs = np.array([p.log for p in paths], float), np.array([p.g for p in paths], float)
                with np.errstate(invalid="ignore"):
                    inclusions = np.where(np.isneginf(thresholds), 1.0, -np.expm1(-np.exp(np.minimum(logs - thresholds, 700))))
                flat, bounds = texts.ids(paths)
                digests = [hashlib.sha256(x).hexdigest() for x in _all_joined(vocab, flat, bounds)]
                last = [digests[i - 1] for i in counts[1:]]
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                samples = pa.StructArray.from_arrays([ids, pa.array(logs, pa.float64()), pa.array(gs, pa.float64()), pa.array(inclusions, pa.float64()), pa.array(digests, pa.string())], fields=list(SAMPLE))
                yield pa.RecordBatch.from_arrays([batch.column("id")[lo:hi], pa.ListArray.from_arrays(pa.array(counts, pa.int32()), samples), pa.array(last, pa.string())], names=["id", "samples", "decoded_sha256"])
                del texts, found, paths, flat, ids, samples

    return run


def sampled_segmentations(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, seed: int = SEED, model: str = MODEL, temper: float = TEMPER) -> DataFrame:
    """One row for each row of df: id, samples (ids of pieces, log_chance, g, inclusion, decoded_sha256) by falling g, decoded_sha256.

    A sample's decoded_sha256 is the digest of the text that its pieces decode to; the row's is the last sample's.

    Samples of a text differ; a text with fewer segmentations than asked for has them all, with
    inclusion 1. An empty or null text has one sample without pieces. The row key is the id; a null
    id is a key of its own. Rows that repeat an id and a text get the same samples. An empty table
    gives an empty result. Other columns are not read. Bytes that are no character of the
    vocabulary are encoded byte by byte; the library's mark for spaces in a text counts as a space.
    """
    kind = dict(df.dtypes)[id_col]
    text = F.replace(text_of(text_col), F.lit(MARK.decode()), F.lit(" "))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col)).alias("key"))
    schema = f"id {kind}, samples array<struct<ids:array<int>,log_chance:double,g:double,inclusion:double,decoded_sha256:string>>, decoded_sha256 string"
    return rows.mapInArrow(_encode(samples, seed, model, temper), schema).withColumnRenamed("id", id_col)


def _decode(path: str, temper: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, temper)
        for batch in batches:
            column = batch.column("ids")
            texts = [None if x is None else _joined(vocab, np.array(x, np.int64)).decode("utf-8", "replace") for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "ids"], pa.array(texts, pa.string())], names=[*[c for c in batch.schema.names if c != "ids"], "text"])

    return run


def decoded(df: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """df with the text of its piece ids as the column text in place of the ids; null ids have a null text.

    df has no other column named text or ids. Bytes that are no UTF-8 become U+FFFD.
    """
    df = df.withColumnRenamed(ids_col, "ids")
    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c != "ids"], "text string"])
    return df.mapInArrow(_decode(model, TEMPER), schema)
