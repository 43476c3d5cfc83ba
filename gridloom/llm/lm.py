"""n-gram scoring with Elias-Fano tries, dealt out by context.

No machine holds the model. Texts are dealt to chunks; a chunk sends each shard the distinct
n-grams it has whose context falls to that shard, with their training counts. A shard sums up the
counts of all chunks one after the other, so that it holds its distinct n-grams and not what each
chunk has sent, builds its trie from them, memory-mapped and compact, and answers each chunk with
the probabilities of the n-grams it sent. The chunk, whose texts are read from the same
shuffle again, adds them up by text.

A trie level has its contexts (sorted hashes, Elias-Fano), pointers to where each context's
successors begin (monotone, Elias-Fano), the successors as context rank and FINGERPRINT bits of the
word's hash (so that the whole level is monotone, Elias-Fano) and a byte each for the logarithm of
the discounted probability and of the context's left-over mass. A query finds its context's rank,
then the successor within the range of its pointers.

The model: p(w | context) = max(c(context w) - DISCOUNT, 0) / c(context) + left-over * p(w | shorter
context), down to the words' own (c + ADD) / (N + ADD * (V + 1)).
"""

from __future__ import annotations

import math
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .elias_fano import EliasFano, encode, mapped
from .tokens import mix, pieces, portions, words

ORDER = 2
DISCOUNT = 0.75
ADD = 0.1
FOLDS = 10
FINGERPRINT = 40
#: log10 of probabilities is kept in steps of RANGE / 254, code 0 meaning none.
RANGE = 12.0
#: Bytes of text that a chunk has, and that a shard's n-grams come from, on average.
CHUNK_BYTES, SHARD_BYTES = 7 << 20, 21 << 20
#: n-grams that a shard adds up at once, and bytes of answers that it gives at once.
GATHERED, GIVEN = 1 << 18, 4 << 20
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _packed(arrays: list[np.ndarray]) -> bytes:
    head = np.array([x for a in arrays for x in (a.dtype.itemsize, len(a))], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(arrays).to_bytes(8, "little") + head + planes)


def _unpacked(blob: bytes, most: int | None = None) -> list[np.ndarray]:
    """The arrays of a blob, or the first ones of them."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2), 8 + 16 * n, []
    for width, count in head[:most].tolist():
        planes = np.frombuffer(raw, np.uint8, width * count, at).reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += width * count
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest type that holds all of x."""
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if int(x.max(initial=0)) <= np.iinfo(t).max))


def coded(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(255 + 254 * np.log10(p) / RANGE), 1, 255), 0).astype(np.uint8)


DECODE = np.append(0.0, 10 ** ((np.arange(1, 256) - 255) * RANGE / 254))


def _placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x in order, and each one's place among them."""
    distinct, at = np.unique(x, return_inverse=True)
    return distinct, at.astype(np.int32)


class _Chunk:
    """Tokens of some texts, their n-grams up to an order, and the distinct ones of each."""

    def __init__(self, ids: list, texts: pa.ChunkedArray, order: int):
        parts = [words(data, offsets) for _, _, data, offsets in pieces(texts)]
        sizes = np.concatenate([np.diff(b) for _, b in parts] or [np.zeros(0, np.int64)])
        hashes = np.concatenate([h for h, _ in parts] or [np.zeros(0, np.uint64)])
        del parts
        rows = len(sizes)
        self.sizes = sizes + 1
        self.row = np.repeat(np.arange(rows, dtype=np.int32), self.sizes)
        tokens = np.full(len(self.row), END)
        tokens[np.arange(len(hashes)) + np.repeat(np.arange(rows), sizes)] = hashes
        del hashes
        begins = np.cumsum(self.sizes) - self.sizes
        train = np.array([zlib.crc32(str(i).encode()) % FOLDS != 0 for i in ids], bool)
        self.held_out = ~train
        weight = train[self.row]
        # Level 1: the words; BEGIN is among them as a context alone, counted never.
        self.known, at = _placed(np.append(tokens, BEGIN))
        self.at, begin = at[:-1], at[-1]
        self.counts = np.bincount(self.at[weight], minlength=len(self.known))
        # Levels 2 to order: (context, successor). A level's contexts are the words, then hashes of words.
        self.levels = []
        context, rank, contexts = None, None, self.known
        for level in range(2, order + 1):
            previous = np.concatenate([[BEGIN], tokens[:-1]])
            previous[begins] = BEGIN
            if level == 2:
                context = previous
                rank = np.concatenate([[begin], self.at[:-1]])
                rank[begins] = begin
            else:
                moved = np.concatenate([[BEGIN], context[:-1]])
                moved[begins] = BEGIN
                context = mix(mix(moved + np.uint64(level)) ^ previous)
                contexts, rank = _placed(context)
            key, place = _placed((rank.astype(np.uint64) << np.uint64(FINGERPRINT)) | (tokens >> np.uint64(64 - FINGERPRINT)))
            owner = (key >> np.uint64(FINGERPRINT)).astype(np.int64)
            self.levels.append({"contexts": contexts, "rank": rank, "place": place, "each": np.bincount(owner, minlength=len(contexts)), "successor": key & np.uint64((1 << FINGERPRINT) - 1), "counts": np.bincount(place[weight], minlength=len(key))})

    def shards(self, n: int) -> dict[int, bytes]:
        """What goes to each shard that anything goes to: words and contexts go by the leading bits of their hash, so a shard's are neighbours."""
        edges = _edges(n)
        out = [[] for _ in range(n)]
        cut = np.searchsorted(self.known, edges)
        for s in range(n):
            a, b = cut[s], cut[s + 1]
            out[s] += [self.known[a:b], _small(self.counts[a:b])]
        for x in self.levels:
            cut = np.searchsorted(x["contexts"], edges)
            first = np.concatenate([[0], np.cumsum(x["each"])])
            for s in range(n):
                a, b = cut[s], cut[s + 1]
                i, j = first[a], first[b]
                low = x["successor"][i:j]
                out[s] += [x["contexts"][a:b] if x["contexts"] is not self.known else self.known[:0], _small(x["each"][a:b]), low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8), _small(x["counts"][i:j])]
        return {s: _packed(arrays) for s, arrays in enumerate(out) if any(len(a) for a in arrays)}


def _edges(shards: int) -> np.ndarray:
    """Where each shard's hashes begin; the last hash of all is nobody's."""
    return np.array([min((s << 64) // shards, 2**64 - 1) for s in range(shards + 1)], np.uint64)


def _count(order: int, shards: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        blobs = _Chunk(table.column("id").to_pylist(), table.column("text"), order).shards(shards)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(blobs), pa.int64()), "shard": pa.array(list(blobs), pa.int32()), "blob": pa.array(list(blobs.values()), pa.binary())})

    return run


def _levels(sent: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of one chunk's arrays, each level's contexts, successors of each, successors and counts."""
    out = []
    for k in range(2, len(sent), 5):
        contexts = sent[0] if k == 2 else sent[k]
        out.append((contexts, sent[k + 1].astype(np.int64), sent[k + 2].astype(np.uint64) | (sent[k + 3].astype(np.uint64) << np.uint64(32)), sent[k + 4]))
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")  # runs that are sorted already are merged
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.add.reduceat(np.concatenate(counts)[order], first, dtype=np.int64) if len(key) else np.zeros(0, np.int64)


def _summed_words(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed([r[0] for r in runs], [r[1].astype(np.int64) for r in runs])


def _summed_grams(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """A run has contexts, the number of successors of each, successors and counts. Runs are summed in bands of contexts; only what training has is kept."""
    first = [np.concatenate([[0], np.cumsum(r[1])]) for r in runs]
    k = max(range(len(runs)), key=lambda i: len(runs[i][2]))
    bands = -(-sum(len(r[2]) for r in runs) // GATHERED)
    edges = np.unique(runs[k][0][np.searchsorted(first[k], [len(runs[k][2]) * i // bands for i in range(1, bands)], "right") - 1])
    cuts = [[0, *np.searchsorted(r[0], edges).tolist(), len(r[0])] for r in runs]
    out = []
    for band in range(len(edges) + 1):
        parts = []
        for r, start, cut in zip(runs, first, cuts, strict=True):
            a, b = cut[band], cut[band + 1]
            parts.append((r[0][a:b], r[1][a:b], r[2][start[a] : start[b]], r[3][start[a] : start[b]]))
        contexts = np.unique(np.concatenate([p[0] for p in parts]))
        key, count = _summed([(np.repeat(np.searchsorted(contexts, c), each).astype(np.uint64) << np.uint64(FINGERPRINT)) | x for c, each, x, _ in parts], [p[3].astype(np.int64) for p in parts])
        key, count = key[count > 0], count[count > 0]
        kinds = np.bincount((key >> np.uint64(FINGERPRINT)).astype(np.int64), minlength=len(contexts))
        out.append((contexts[kinds > 0], kinds[kinds > 0], key & np.uint64((1 << FINGERPRINT) - 1), _small(count)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Sums:
    """Runs of counts, summed as they come: some small ones together, then always those of a like size, so that little more is held than what is distinct."""

    def __init__(self, summed: Callable[[list], tuple]):
        self.summed, self.small, self.size, self.runs = summed, [], 0, []

    def add(self, run: tuple) -> None:
        self.small.append(run)
        self.size += len(run[-1])
        if self.size >= GATHERED:
            self._gather()

    def _gather(self) -> None:
        run, self.small, self.size = self.summed(self.small), [], 0
        while self.runs and len(self.runs[-1][-1]) < 2 * len(run[-1]):
            run = self.summed([self.runs.pop(), run])
        self.runs.append(run)

    def all(self) -> tuple:
        if self.small:
            self._gather()
        while len(self.runs) > 1:
            self.runs.append(self.summed([self.runs.pop(), self.runs.pop()]))
        return self.runs.pop()


class Trie:
    """One shard's levels: words with counts, then contexts, pointers, successors and their codes. Chunks' arrays are taken one after the other."""

    def __init__(self, sent: Iterable[list[np.ndarray]]):
        known, sums = _Sums(_summed_words), []
        for x in sent:
            known.add((x[0], x[1]))
            for k, run in enumerate(_levels(x)):
                if k == len(sums):
                    sums.append(_Sums(_summed_grams))
                sums[k].add(run)
        self.words, self.counts = known.all()
        levels = []
        # Only contexts that training has seen are in the trie.
        for k in range(len(sums)):
            contexts, kinds, key, count = sums[k].all()
            pointers = np.concatenate([[0], np.cumsum(kinds)])
            total = np.add.reduceat(count, pointers[:-1], dtype=np.int64) if len(count) else np.zeros(0, np.int64)
            left = coded(DISCOUNT * kinds / total)
            found = np.zeros(len(key), np.uint8)
            for a, b in portions(kinds, GATHERED):
                i, j = pointers[a], pointers[b]
                found[i:j] = coded((count[i:j] - DISCOUNT) / np.repeat(total[a:b], kinds[a:b]))
                key[i:j] |= np.repeat(np.arange(a, b, dtype=np.uint64), kinds[a:b]) << np.uint64(FINGERPRINT)
            levels += [encode(contexts, 2**64 - 1), encode(pointers, int(pointers[-1]) + 1), encode(key, max(1, len(contexts)) << FINGERPRINT), [left], [found]]
        levels = mapped(levels)
        self.levels = [([EliasFano(p) for p in levels[k : k + 3]], levels[k + 3][0], levels[k + 4][0]) for k in range(0, len(levels), 5)]

    def answer(self, sent: list[np.ndarray]) -> list[np.ndarray]:
        """For one chunk's arrays: its words' counts; by level its contexts' left-over codes and its n-grams' codes."""
        out = [_small(self.counts[np.searchsorted(self.words, sent[0])])]
        for (contexts, pointers, successors), left, found in self.levels:
            asked, each, successor, _ = _levels(sent)[len(out) // 2]
            rank, known = contexts.successor(asked) if contexts.n else (np.zeros(len(asked), np.int64), np.zeros(len(asked), bool))
            mass = np.zeros(len(asked), np.uint8)
            mass[known] = left[rank[known]]
            codes = np.zeros(len(successor), np.uint8)
            here = np.flatnonzero(np.repeat(known, each))
            for part in np.array_split(here, max(1, len(here) >> 16)):
                if len(part):
                    own = np.repeat(rank, each)[part] if len(here) <= 1 << 16 else np.repeat(rank, each).take(part)
                    x = (own.astype(np.uint64) << np.uint64(FINGERPRINT)) | successor[part]
                    at, hit = successors.successor(x)
                    hit &= at < pointers.get(own + 1).astype(np.int64)
                    codes[part[hit]] = found[at[hit]]
            out += [mass, codes]
        return out


def _answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks, sizes = [], []
    with tempfile.TemporaryFile(prefix="sent-") as file:  # what was sent is read again to be answered

        def sent() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                chunks.extend(batch.column("chunk").to_pylist())
                for blob in batch.column("blob"):
                    sizes.append(file.write(blob.as_buffer()))
                    yield _unpacked(blob.as_buffer())

        trie = Trie(sent())
        file.seek(0)
        for a, b in portions(np.array(sizes), GIVEN):
            blobs = [_packed(trie.answer(_unpacked(file.read(size)))) for size in sizes[a:b]]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunks[a:b], pa.int64()), "shard": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _totals(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Sums(_summed_words)
    for batch in batches:
        for blob in batch.column("blob"):
            known.add(tuple(_unpacked(blob.as_buffer(), 2)))
    _, counts = known.all()
    yield pa.RecordBatch.from_pydict({"n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([int((counts > 0).sum())], pa.int64())})


def _score(order: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(table.column("id").to_pylist(), table.column("text"), order)
        answers = answers.sort_by("shard")
        got = [_unpacked(b) for b in answers.column("blob").to_pylist()]
        n, v = answers.column("n")[0].as_py(), answers.column("v")[0].as_py()
        counts = np.concatenate([g[0] for g in got]).astype(np.float64)
        if len(counts) != len(chunk.known):
            raise RuntimeError("a chunk's answers don't fit its words")
        known = (counts > 0)[chunk.at]
        base = np.log10((counts + ADD) / (n + ADD * (v + 1)))[chunk.at]
        p = 10**base
        for k, level in enumerate(chunk.levels):
            mass = DECODE[np.concatenate([g[1 + 2 * k] for g in got])]
            code = DECODE[np.concatenate([g[2 + 2 * k] for g in got])]
            mass = np.where(mass > 0, mass, 1.0)[level["rank"]]
            p = code[level["place"]] + mass * p
        rows = len(chunk.sizes)
        total = lambda x: np.bincount(chunk.row, x, rows)
        return pa.table({
            "id": table.column("id"), "held_out": pa.array(chunk.held_out), "n_tokens": pa.array(chunk.sizes, pa.int64()), "n_known": pa.array(total(known).astype(np.int64)),
            "train_tokens": pa.array(np.full(rows, n), pa.int64()), "base_score": pa.array(total(base)), "score": pa.array(total(np.log10(p))),
        })

    return run


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id as text isn't divisible by ten and scores all. A
    null text is empty: its only token is the end. A null id counts as the text "None" and is
    carried. Repeated rows count as often as they come. If nothing trains, every token has the same
    chance. An empty table gives an empty result. Other columns are not read.

    Words are told apart by hashes of 64 bits: two of n different ones share theirs with a chance of
    n * n / 2 ** 65. Chunks and shards follow from the bytes of all texts, so that a task's share
    stays the same; a chunk sends to a shard only what it has for it, so that what is sent is never
    more than the chunks' distinct n-grams.
    """
    text = text_of(text_col)
    size = df.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    chunks, shards = (max(1, math.ceil(size / x)) for x in (chunk_bytes, shard_bytes))
    kind = dict(df.dtypes)[id_col]
    dealt = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    blobs = dealt.groupBy("chunk").applyInArrow(_count(order, shards), "chunk long, shard int, blob binary")
    by_shard = blobs.groupBy("shard")
    totals = by_shard.applyInArrow(_totals, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))  # one row
    answers = by_shard.applyInArrow(_answer, "chunk long, shard int, blob binary").crossJoin(F.broadcast(totals))
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(order), schema)
    return out.withColumnRenamed("id", id_col)
