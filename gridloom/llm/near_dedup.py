"""Near-duplicates by one-permutation MinHash, optimal densification, banded buckets and star-shaped candidates.

1. Each text becomes its set of shingle hashes. Equal sets are one class from here on, found by
   grouping set fingerprints, and has a number.
2. A set's hashes fall into BINS bins by their leading bits; the least of each bin is its MinHash.
   An empty bin borrows from the first filled one along a fixed permutation of its own, the same
   for all sets (optimal densification). Bins make bands, and bands make buckets. A band has as
   many bins as leave two sets of just the wanted similarity without a bucket in common with a
   chance of MISSED at most: 6 at 0.85 (6e-9), 5 at 0.8 (5e-9).
3. Stars: within a bucket each class meets the bucket's least one alone, and of all the stars a
   class is in, only its least centre whose sketch is close enough: at most one pair a class.
4. Pairs are confirmed on their full sets and make components.
5. What a star can miss are links between members of a bucket which are in different components
   by now. The members of buckets that still hold several meet in blocks, first by their sketches
   alone, which tells the members that have anything close in another component; then those meet
   with their texts, and a block sends out only links that join two components it had apart. The
   blocks of the centre's own component don't meet one another. So no link is lost, and no bucket
   emits its pairs.

A sketch is one byte a bin. Pairs of similarity 0.85 agree in 204 of 240 bins, give or take 6;
those with fewer agreements than SPREADS standard deviations below that are not compared: under
168 at 0.85, 151 at 0.8. Simulated sets with 20 to 300 shingles between them, of just these
similarities, are 5.3 to 6.9 of their own deviations above that: by the normal tail under 1e-7 miss.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.network import components
from .common import cut, discard, fresh, swept, text_of
from .tokens import mix, pieces, shingle_sets

BINS = 240
MISSED, SPREADS = 1e-8, 6.5
#: Below LEAST percent, bands of few bins would bring most sets together.
LEAST = 50
PERCENT = 85
WIDTH = 3
#: Members of a block, and shingles of their sets, on average.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
PER_CENTRE = 256
#: A row's id, and what tells it from others of that id: two hashes of id and text, 96 bits.
ROW = ("id", "doc", "doc2")


def _rows(percent: int) -> int:
    """Bins of a band, so that pairs of that similarity miss each other with a chance of MISSED at most."""
    if not LEAST <= percent <= 100:
        raise ValueError(f"a similarity of {percent} percent; the sketches serve {LEAST} to 100")
    return max(r for r in range(1, BINS + 1) if BINS % r == 0 and (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED)


def _least_agreed(percent: int) -> int:
    """Bins that pairs of that similarity agree in, at least."""
    return math.floor(BINS * percent / 100 - SPREADS * math.sqrt(BINS * percent * (100 - percent)) / 100)


def _probes(bins: int) -> np.ndarray:
    """For each bin the bins it borrows from, in order: itself first, then a permutation fixed by its number."""
    order = np.argsort(mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(977)).reshape(bins, bins), axis=1)
    return np.concatenate([np.arange(bins)[:, None], order], axis=1)


def _signature(ordered: np.ndarray, probes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """MinHash of each bin of a set of sorted hashes that isn't empty."""
    at = np.searchsorted(ordered, edges)
    filled = np.append(at[1:], len(ordered)) > at
    source = np.arange(len(edges)) if filled.all() else probes[np.arange(len(edges)), filled[probes].argmax(axis=1)]
    return ordered[at[source]]


def _signed(width: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probes(BINS)
        edges = np.array([(b << 64) // BINS for b in range(BINS)], np.uint64)
        place = mix(np.arange(BINS, dtype=np.uint64) + np.uint64(31))
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("text")):
                sizes, first, second, bands, sketches = [], [], [], [], []
                for found in shingle_sets(data, offsets, width):
                    sizes.append(len(found))
                    spread = mix(found + np.uint64(7))
                    first.append(int(spread.sum(dtype=np.uint64).view(np.int64)))
                    second.append(int(np.bitwise_xor.reduce(mix(spread)).view(np.int64)) if len(found) else 0)
                    if not len(found):
                        bands.append([])
                        sketches.append(b"")
                        continue
                    own = mix(_signature(found, probes, edges) ^ place)
                    key = own.reshape(-1, rows)
                    band = key[:, 0]
                    for r in range(1, rows):
                        band = mix(band ^ key[:, r])
                    bands.append(band.view(np.int64))
                    sketches.append((own >> np.uint64(13)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[lo:hi] for c in ROW), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=[*ROW, "n", "f1", "f2", "bands", "sketch"],
                )

    return run


def _close(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
            keep = (a == b).sum(axis=1) >= least if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep))

    return run


class _Apart:
    """Which components are still apart."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _closely(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, sides: np.ndarray, p: int, q: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of block p with the rows of block q that are close by size and sketch and of another component."""
    right, least = np.flatnonzero(sides == q), _least_agreed(percent)
    for i in np.flatnonzero(sides == p) if (labels != labels[0]).any() else ():
        js = right[right > i] if p == q else right
        js = js[(labels[js] != labels[i]) & (100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i]))]
        js = js[(sketch[js] == sketch[i]).sum(axis=1) >= least]
        if len(js):
            yield int(i), js


def _linked(sets: list[np.ndarray], ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, sides: np.ndarray, p: int, q: int, percent: int) -> list[tuple[int, int]]:
    """Links between blocks p and q that join components."""
    apart, out = _Apart(), []
    for i, js in _closely(ids, labels, sizes, sketch, sides, p, q, percent):
        js = np.array([j for j in js if apart.root(int(labels[j])) != apart.root(int(labels[i]))], np.int64)
        for some in np.array_split(js, max(1, len(js) // 256)):
            if not len(some):
                continue
            flat = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            shared = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for j in some[100 * shared >= percent * (sizes[i] + sizes[some] - shared)]:
                if apart.join(int(labels[i]), int(labels[j])):
                    out.append((int(ids[i]), int(ids[j])))
    return out


def _blocks(percent: int, width: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by bucket and pair of blocks (p, q); within p = q all meet, else those across.

    Without a width there are no texts, and what comes out are the members that have something
    close (key, p, q, id); with one the joining links (u, v).
    """

    def done(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        ids, labels, sizes, sides = (np.array([r[k] for r in rows]) for k in range(4))
        sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, BINS)
        if width:
            sets = [x for _, _, data, offsets in pieces(pa.array([r[5] for r in rows], pa.large_string())) for x in shingle_sets(data, offsets, width)]
            found = _linked(sets, ids, labels, sizes, sketch, sides, key[1], key[2], percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
        near = np.zeros(len(ids), bool)
        for i, js in _closely(ids, labels, sizes, sketch, sides, key[1], key[2], percent):
            near[i] = near[js] = True
        n = int(near.sum())
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int32()), pa.array([key[2]] * n, pa.int32()), pa.array(ids[near], pa.int64())], names=["key", "p", "q", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "p", "q", "id", "label", "n", "block", "sketch", *(["text"] if width else []))]
            for row in zip(*columns, strict=True):
                if row[:3] != key:
                    if held:
                        yield done(key, held)
                    held, key = [], row[:3]
                held.append(row[3:])
        if held:
            yield done(key, held)

    return run


def _confirm(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by centre and part, the centre's own text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for batch in batches:
            keys = list(zip(batch.column("centre").to_pylist(), batch.column("part").to_pylist(), batch.column("id").to_pylist(), strict=True))
            us, vs = [], []
            for lo, hi, data, offsets in pieces(batch.column("text")):
                for row, found in zip(keys[lo:hi], shingle_sets(data, offsets, width), strict=True):
                    if row[0] == row[2]:
                        key, centre = row[:2], found
                        continue
                    if row[:2] != key:
                        raise RuntimeError("a centre's text is missing")
                    shared = len(np.intersect1d(centre, found, assume_unique=True))
                    if 100 * shared >= percent * (len(centre) + len(found) - shared):
                        us.append(row[2])
                        vs.append(row[0])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (u, v), distinct, those whose sets are similar enough. texts: id, text.

    Each pair's v is its centre. A centre's members are dealt to parts of about PER_CENTRE, each
    with a copy of the centre's text; a task holds one centre and one batch at a time.
    """
    parts = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / PER_CENTRE).cast("int").alias("parts"))
    members = pairs.join(parts, "v").select(F.col("u").alias("id"), F.col("v").alias("centre"), F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("place"))
    centres = parts.select(F.col("v").alias("id"), F.col("v").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"))
    rows = members.unionAll(centres).join(texts, "id")
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "place")
    return rows.select("centre", "part", "id", "text").mapInArrow(_confirm(width, percent), "u long, v long")


def _texts(rows: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """id, text of the classes in nodes (id): whole texts move once, by their row's hashes."""
    wanted = classes.join(nodes.distinct(), "id", "left_semi").select("id", "doc", "doc2")
    return rows.select("doc", "doc2", "text").join(wanted, ["doc", "doc2"]).select("id", "text")


def _apart(shared: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components: key, p, q, id, label, block.

    The component of a bucket's centre, which nearly all members of a large bucket are in by now, is
    dealt to blocks of its own, and no two of these meet: a member of it is copied once for each
    block of the others, and only the others meet all.
    """
    labelled = shared.join(labels, "id", "left").select("key", "id", "centre", F.coalesce("component", "id").alias("label"))
    spread = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max(F.when(F.col("id") == F.col("centre"), F.col("label"))).alias("main"))
    still = labelled.join(spread.filter("least < most").select("key", "main"), "key").join(sizes, "id")
    still = cut(still.select("key", "id", "n", "label", (F.col("label") == F.col("main")).alias("own")))

    def blocks(which: Column) -> Column:
        return F.ceil(F.greatest(F.count(F.when(which, 1)) / BLOCK, F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")

    dealt = still.groupBy("key").agg(blocks(F.col("own")).alias("owns"), blocks(~F.col("own")).alias("others"))
    place = F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("owns")).otherwise(F.col("others"))).cast("int")
    block = F.when(F.col("own"), F.col("others") + place).otherwise(place)
    last = F.when(F.col("own"), F.col("others")).otherwise(F.col("others") + F.col("owns")) - 1
    met = F.transform(F.sequence(F.lit(0), F.col("last")), lambda other: F.struct(F.least("block", other).alias("p"), F.greatest("block", other).alias("q")))
    out = still.join(dealt, "key").select("key", "id", "label", block.alias("block"), last.alias("last")).withColumn("pair", F.explode(met))
    return out.select("key", "pair.p", "pair.q", "id", "label", "block")


def _members(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """A row for each row of df: id, doc, doc2, n, f1, f2, node (null for an empty set), class_id, part (the component's node), component_id."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("doc"), F.hash("text", "id").alias("doc2"), "text")
    signed = cut(rows.mapInArrow(_signed(width, _rows(percent)), "id long, doc long, doc2 int, n long, f1 long, f2 long, bands array<long>, sketch binary"))
    # Rows of equal sets are merged before they move, however many there are; classes are numbered once they are written.
    owner = F.struct("doc", "doc2", "bands", "sketch")
    classes = signed.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("class_id"), F.min(owner).alias("o"))
    classes = swept(cut(classes.select(F.monotonically_increasing_id().alias("id"), "n", "f1", "f2", "class_id", "o.*")))
    sketches = classes.select("id", "n", "sketch")
    buckets = classes.select("id", F.posexplode("bands").alias("band", "hash")).select("id", F.xxhash64("band", "hash").alias("key"))
    centres = buckets.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = swept(cut(buckets.join(centres, "key").select("key", "id", "centre")))

    def sketched(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select(F.col("id").alias(side), F.col("sketch").alias(f"sketch_{name}"), F.col("n").alias(f"n_{name}")) for side, name in (("u", "a"), ("v", "b")))
        sized = pairs.join(a, "u").join(b, "v").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        return sized.select("u", "v", "sketch_a", "sketch_b").mapInArrow(_close(_least_agreed(percent)), "u long, v long")

    stars = sketched(shared.filter("id != centre").select(F.col("id").alias("u"), F.col("centre").alias("v")).distinct())
    stars = swept(cut(stars.groupBy("u").agg(F.min("v").alias("v"))))
    ends = stars.select(F.col("u").alias("id")).unionAll(stars.select(F.col("v").alias("id")))
    links = swept(cut(confirmed(stars, _texts(rows, ends, classes), width, percent)))

    mine = _apart(shared, components(links), classes.select("id", "n")).join(sketches, "id").select("key", "p", "q", "id", "label", "n", "block", "sketch")

    def gathered(members: DataFrame) -> DataFrame:
        return members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id")

    near = swept(cut(gathered(mine).mapInArrow(_blocks(percent, None), "key long, p int, q int, id long"), stars))
    close = mine.join(near, ["key", "p", "q", "id"], "left_semi").join(_texts(rows, near.select("id"), classes), "id")
    rest = swept(cut(gathered(close).mapInArrow(_blocks(percent, width), "u long, v long")))
    final = components(links.unionAll(rest))
    discard(links, rest, near, shared)

    named = classes.join(final, "id", "left").select("n", "f1", "f2", "class_id", F.coalesce("component", "id").alias("part"))
    least = named.groupBy("part").agg(F.min("class_id").alias("component_id"))
    named = cut(named.join(least, "part"))
    return signed.select(*ROW, "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id, kept, class_id (least id with the same set).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text of fewer words than
    `width` is one shingle; a text without words, or null, links with nothing. Ids are whole
    numbers: rows that repeat an id are documents of their own, linked by their texts and told apart
    by nothing else; all rows of a component's least id are kept. A null id is never the least but
    where a component has no other, whose rows are all kept. percent is LEAST to 100. An empty table
    gives an empty result. Other columns are not read.

    Shingles are compared by hashes of 64 bits: two of n different ones in the table share theirs
    with a chance of n * n / 2 ** 65, which changes a similarity by one shingle.
    """
    out = _members(df, id_col, text_col, width, percent)
    some = F.col("n") > 0
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.when(some, F.col("class_id")).otherwise(F.col("id")).alias("class_id"))
    return out.select(id_col, "n_shingles", "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component of df, with all of its columns.

    It is the one of the least id, null last; where several texts of that id are in the component,
    the one of the least hash. Rows that repeat an id and its text are one document and stay
    together. Texts without words all stay. An empty table gives an empty result.
    """
    members = _members(df, id_col, text_col, width, percent)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), *ROW)).alias("m")
    kept = members.filter("n > 0").groupBy("part").agg(first).select("m.doc", "m.doc2").unionAll(members.filter("n = 0").select("doc", "doc2"))
    doc, doc2 = fresh(df, "doc", "doc2")
    key = F.col(f"`{id_col}`").cast("long"), text_of(F.col(f"`{text_col}`"))
    rows = df.withColumns({doc: F.xxhash64(*key), doc2: F.hash(*key[::-1])})
    return rows.join(kept.select(F.col("doc").alias(doc), F.col("doc2").alias(doc2)), [doc, doc2], "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
