"""The operators of the subpackage against plain versions, on small tables with every awkward row."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import chat, elias_fano, licences, lm, mixing, near_dedup, quality, segment, substrings
from gridloom.llm.exact_dedup import exact_dedup, keep_first
from gridloom.llm.secrets import secrets
from gridloom.operators.network import components

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEY = "d41d8cd98f00b204e9800998ecf8427e"


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


BASE = prose(120, 1)
WORDS = BASE.split()
TEXTS = [
    BASE, BASE, BASE.replace(" ", "\n", 3), " ".join(WORDS[:-2]), " ".join(WORDS[2:]), " ".join(WORDS[:60]), None, "", "  \n\t ", "one", "One", "one two", prose(80, 2), prose(80, 2).upper(),
    prose(30, 3) + " " + " ".join(WORDS[30:110]) + " " + prose(30, 4), "é" * 30 + " " + "ß", prose(3000, 5), "spam spam spam " * 40, "### $$$ !!! " * 30, f"token = '{KEY}' and password: abc, api_key=Zx9/Qw8+Er7=Ty6u", "AKIA" + "Z" * 16 + " " + KEY,
    "The cat\n\nsat.\n" * 3,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids from 3 on, out of order, beside columns that clash with the operators' own."""
    rows = [((i * 7) % len(TEXTS) + 3, t, "x", i, "y", 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string, row int, digest string, kept double").repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}


def shingles(text):
    w = re.findall(WORD, text.translate(LOWER))
    return set(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else {tuple(w)} if w else set()


def test_exact_dedup(spark, docs, plain):
    same = {}
    for i, t in plain.items():
        same.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in same.items() for i in g}
    for digest in (None, F.length):  # a digest that many texts share merges nothing
        got = exact_dedup(docs, **({"digest": digest} if digest else {}))
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(min(g) for g in same.values())
    assert exact_dedup(docs.filter("false")).count() == 0
    assert keep_first(docs.union(docs)).count() == len(same)


def test_components(spark):
    edges = spark.createDataFrame([(1, 5), (5, 9), (9, 2), (7, 7), (4, 3), (3, 4), (None, 1)], "u bigint, v bigint")
    assert {r[0]: r[1] for r in components(edges).collect()} == {1: 1, 5: 1, 9: 1, 2: 1, 3: 3, 4: 3}


def test_near_dedup(spark, docs, plain):
    sets = {i: shingles(t) for i, t in plain.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = near_dedup.near_dedup(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == {i: (len(sets[i]), root[i], i == root[i]) for i in sets}
    assert near_dedup.near_dedup(docs.filter("false")).count() == 0


def test_near_dedup_finds_links_that_stars_miss(spark, monkeypatch):
    """A chain of near copies in small blocks: most links are between members that aren't the centre."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    words, rng = prose(200, 11).split(), np.random.default_rng(5)
    chain = []
    for _ in range(24):
        chain.append(" ".join(words))
        for at in rng.choice(200, 5, replace=False):
            words[at] = prose(1, int(rng.integers(1 << 30)))
    df = spark.createDataFrame([(int(i), chain[k]) for k, i in enumerate(rng.permutation(24))], "doc_id bigint, text string")
    sets = {r[0]: shingles(r[1]) for r in df.collect()}
    root = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(df).collect()} == root


def test_near_dedup_null_and_repeated_ids(spark):
    """A row for each row: null ids are never the least of others, an id may have two texts."""
    one, two, alone = prose(100, 41), prose(100, 42), prose(100, 43)
    rows = [(None, one), (5, one), (5, one), (2, one + " end"), (2, two), (7, two + " end"), (None, alone), (None, None), (9, " "), (None, two)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, component_id string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_dedup(df).collect())
    assert got == sorted([(0, 2, False), (5, 2, False), (5, 2, False), (2, 2, True), (2, 2, True), (7, 2, False), (0, 0, True), (0, 0, True), (9, 9, True), (0, 2, False)])
    kept = near_dedup.keep_one(df).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(2, one + " end"), (2, two), (0, alone), (0, ""), (9, " ")])
    assert set(kept[0].asDict()) == {"doc_id", "text", "component_id"}


def test_near_dedup_blocks_of_the_centre(spark, monkeypatch):
    """Two large families share buckets; members of the centre's family are not dealt to meet one another."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    words, rng, texts = prose(120, 51).split(), np.random.default_rng(6), []
    for change in (0, 14):
        family = [f"{w}q" if i < change else w for i, w in enumerate(words)]
        for _ in range(20):
            texts.append(" ".join(f"{w}z" if i == at else w for at in [int(rng.integers(20, 120))] for i, w in enumerate(family)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    root = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(df).collect()} == root


def test_near_dedup_at_other_similarities(spark):
    assert (near_dedup._rows(85), near_dedup._least_agreed(85)) == (6, 168)
    words, rng = prose(200, 21).split(), np.random.default_rng(4)
    texts = []
    for _ in range(12):
        texts.append(" ".join(words))
        for at in rng.choice(200, 14, replace=False):
            words[at] = prose(1, int(rng.integers(1 << 30)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    root = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if 100 * len(a & b) >= 60 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert len(set(root.values())) < 6
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(df, percent=60).collect()} == root
    with pytest.raises(ValueError):
        near_dedup.near_dedup(df, percent=20)


def test_pipeline_takes_near_copies_by_five_words(spark):
    """A text cut by 18 percent goes; one with five of 200 words changed stays, though 0.86 alike by three words."""
    one, two = prose(200, 31).split(), prose(200, 32).split()
    changed = [f"{w}x" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(two)]
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(one[:164])), (3, " ".join(two)), (4, " ".join(changed))], "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()} == {1, 3, 4}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    probes, edges = near_dedup._probes(240), np.array([(b << 64) // 240 for b in range(240)], np.uint64)
    for n in (12, 300, 4000):
        pool = rng.integers(0, 2**64, n + n // 8, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 8 :])
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = np.mean(near_dedup._signature(a, probes, edges) == near_dedup._signature(b, probes, edges))
        assert abs(got - want) < 0.2


def test_quality_counts(docs, plain):
    for r in quality.quality_rules(docs).collect():
        t = plain[r.doc_id]
        w, lines = re.findall(WORD, t), [x for x in t.split("\n") if re.search(WORD, x)]
        windows = list(zip(w, w[1:], w[2:], strict=False))
        often, cover = Counter(windows), set()
        for i, x in enumerate(windows):
            if often[x] > 1:
                cover |= {i, i + 1, i + 2}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_quality_learns(spark, docs):
    good = [(i, prose(90, 100 + i)) for i in range(60)]
    junk = [(60 + i, " ".join(f"{w}{'#$%&'[k % 4] * 3}" for k, w in enumerate(prose(90, 500 + i).split()))) for i in range(8)]
    df = spark.createDataFrame(good + junk, "doc_id bigint, text string")
    assert {r.doc_id for r in quality.quality_rules(df).filter("kept").collect()} == set(range(60))
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == list(range(60))
    assert quality.quality_rules(docs.filter("false")).count() == 0 and quality.keep_good(docs).columns == docs.columns


def test_secrets(docs, plain):
    for r in secrets(docs).collect():
        t, spans = plain[r.doc_id], []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, m.end(), "assign"))
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("entropy")] == [s for s in joined.split(",") if s]
    assert secrets(docs.filter("false")).count() == 0


def test_window_entropy(spark):
    value = "aB3" + "xK9mQ2vL7tR4wZ8nC5jH1bF6" + "aaaaaaaaaaaaaaaaaaaaaaa"
    texts = [(0, f"see {value} there"), (1, "a" * 40 + "1B"), (2, "EXAMPLE" + value), (3, "thequickbrownfoxjumpsoverthelazydog"), (4, "12345678901234567890123456")]
    hot = []
    for i in range(len(value) - 19):
        c = Counter(value[i : i + 20])
        if -sum(n / 20 * math.log2(n / 20) for n in c.values()) >= 3.7:
            hot.append(i)
    rows = secrets(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    got = {r.doc_id: ",".join(x for x in r.spans.split(",") if x.startswith("entropy")) for r in rows}
    assert got == {0: f"entropy:{4 + hot[0]}:{4 + hot[-1] + 20}", 1: "", 2: "", 3: "", 4: ""}


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, u in ((0, 10), (1, 1), (500, 600), (2000, 1 << 40), (300, 1 << 63)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        ef = elias_fano.EliasFano(elias_fano.mapped([elias_fano.encode(v, u)])[0])
        if n:
            assert (ef.get(np.arange(n)) == v).all()
            ask = np.concatenate([v, rng.integers(0, u, 200, dtype=np.uint64)])
            at, hit = ef.successor(ask)
            assert (hit == np.isin(ask, v)).all() and (at == np.searchsorted(v, ask)).all()


@pytest.mark.parametrize("order", [2, 3])
def test_lm(docs, plain, order):
    tokens = {i: [*re.findall(WORD, t.translate(LOWER)), None] for i, t in plain.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c, grams, contexts = Counter(), Counter(), Counter()
    context = lambda x, k, m: tuple(x[j] if j >= 0 else 0 for j in range(k - m + 1, k))
    for i, x in tokens.items():
        if not held[i]:
            c.update(x)
            for k, w in enumerate(x):
                for m in range(2, order + 1):
                    grams[context(x, k, m), w] += 1
                    contexts[context(x, k, m)] += 1
    kinds = Counter(k for k, _ in grams)
    n, z = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    rows = lm.lm_scores(docs, order=order, chunk_bytes=4000, shard_bytes=9000).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        x, base, score = tokens[r.doc_id], 0.0, 0.0
        for k, w in enumerate(x):
            p = (c[w] + 0.1) / z
            base += math.log10(p)
            for m in range(2, order + 1):
                if total := contexts[key := context(x, k, m)]:
                    p = max(grams[key, w] - 0.75, 0) / total + 0.75 * kinds[key] / total * p
            score += math.log10(p)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(x), sum(c[w] > 0 for w in x), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and abs(r.score - score) < 0.05 * len(x)
    assert lm.lm_scores(docs.filter("false")).count() == 0


def _sent(texts, order, shards=1):
    """By shard, what each chunk of some texts sends it."""
    blobs = [lm._Chunk(ids, pa.chunked_array([x]), order).shards(shards) for ids, x in texts]
    return [[lm._unpacked(b[s]) for b in blobs if s in b] for s in range(shards)]


def _peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_lm_shard_holds_what_is_distinct():
    """A shard's memory doesn't grow with the chunks that send it the same n-grams, and a number that is encoded takes some bytes."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 20_000, 60)) for _ in range(1000)]
    few = _sent([([1] * len(texts), pa.array(texts))] * 4, 2)[0]
    grams = len(few[0][4])
    trie, little = _peak(lambda: lm.Trie(few))
    many, much = _peak(lambda: lm.Trie(few * 16))
    assert grams > 50_000 and much < 2 * little and much < 100 * (1 << 18)
    assert (many.counts == 16 * trie.counts).all()
    values = np.sort(rng.integers(0, 1 << 60, 200_000, dtype=np.uint64))
    assert _peak(lambda: elias_fano.encode(values, 1 << 60))[1] < 100 * len(values)


@pytest.mark.parametrize("gathered", [1, 50, 1 << 18])
def test_lm_shard_sums_chunks_in_runs(monkeypatch, gathered):
    monkeypatch.setattr(lm, "GATHERED", gathered)
    rng = np.random.default_rng(9)
    chunks = [([*range(k, k + 4)], pa.array([" ".join(rng.choice(list("abcdefgh"), 30)) for _ in range(3)] + [None])) for k in range(0, 40, 4)]
    c, grams = Counter(), Counter()
    for ids, texts in chunks:
        for i, t in zip(ids, texts.to_pylist(), strict=True):
            if zlib.crc32(str(i).encode()) % 10:
                x = [None, *(t or "").split(), None]
                c.update(x[1:])
                grams.update(zip(x, x[1:], strict=False))
    plain = _sent(chunks, 3)[0]
    trie = lm.Trie(plain)
    assert sorted(trie.counts) == sorted([*c.values(), 0])  # BEGIN is never counted
    (contexts, pointers, successors), left, found = trie.levels[0]
    total = Counter()
    for (a, _), n in grams.items():
        total[a] += n
    assert (contexts.n, successors.n) == (len(total), len(grams)) and pointers.get(np.array([pointers.n - 1]))[0] == len(grams)
    want = [lm.coded(np.array([(n - 0.75) / total[a]]))[0] for (a, _), n in grams.items()]
    assert sorted(found) == sorted(want)
    kinds = Counter(a for a, _ in grams)
    assert sorted(left) == sorted(lm.coded(np.array([0.75 * kinds[a] / total[a]]))[0] for a in total)
    # Many shards say together what one says.
    parts = _sent(chunks, 3, 5)
    assert sum(lm.Trie(x).levels[1][0][2].n for x in parts if x) == trie.levels[1][0][2].n


def test_lm_shard_takes_batches():
    """Blobs come in batches of any size, and are answered in their order."""
    texts = [([k], pa.array([f"a b{k} a c"])) for k in range(9)]
    blobs = [lm._Chunk(ids, pa.chunked_array([x]), 2).shards(1)[0] for ids, x in texts]
    table = pa.table({"chunk": pa.array(range(9), pa.int64()), "shard": pa.array([0] * 9, pa.int32()), "blob": pa.array(blobs, pa.binary())})
    key = (pa.scalar(0, pa.int32()),)
    out = [pa.Table.from_batches(list(lm._answer(key, iter(table.to_batches(max_chunksize=n))))) for n in (1, 4, 9)]
    assert out[0] == out[1] == out[2] and out[0].column("chunk").to_pylist() == list(range(9))
    n, v = (pa.Table.from_batches(list(lm._totals(key, iter(table.to_batches(max_chunksize=4))))).column(x)[0].as_py() for x in "nv")
    trained = [k for k in range(9) if zlib.crc32(str(k).encode()) % 10]
    assert (n, v) == (5 * len(trained), 3 + len(trained))


def test_mixing(spark):
    rng = np.random.default_rng(6)
    word = {"clean": "sun sea hill".split(), "toxic": "scum moron trash".split()}
    rows = [(i, " ".join(rng.choice(word[d] + ["the", "of", "and"] * 3, 40)), d) for i in range(200) for d in [("clean", "toxic")[i % 4 == 0]]]
    df = spark.createDataFrame([r[:2] for r in rows] + [(200, None), (201, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, d) for i, _, d in rows if i < 100] + [(5, None), (999, "toxic")], "id bigint, domain string")
    got = {r.doc_id: r for r in mixing.mix_rates(df, labels, ("clean", "toxic"), (0.9, 0.1)).collect()}
    assert np.mean([got[i].domain == d for i, _, d in rows if i >= 100]) > 0.95
    total = sum(r.n_tokens for r in got.values())
    for d, share in (("clean", 0.9), ("toxic", 0.1)):
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got.values()) / total - share) < 1e-4
    assert all(r.rate >= 0 for r in got.values()) and got[200].n_tokens == 0
    kept = {r.doc_id for r in mixing.drawn(df, labels, ("clean", "toxic"), (1.0, 0.0)).collect()}
    assert {i for i, _, d in rows if d == "clean"} <= kept and len(kept & {i for i, _, d in rows if d == "toxic"}) < 5
    assert mixing.mix_rates(df.filter("false"), labels, ("clean", "toxic"), (0.5, 0.5)).count() == 0
    # Labels of ids that aren't there use up none of the sample; ids in two domains count for the lesser.
    strangers = spark.createDataFrame([(10_000 + i, "toxic") for i in range(300)] + [(0, "toxic"), (None, "toxic")], "id bigint, domain string")
    few = {r.doc_id: r.domain for r in mixing.mix_rates(df, labels.union(strangers), ("clean", "toxic"), (0.9, 0.1), sample=100).collect()}
    assert np.mean([few[i] == d for i, _, d in rows if i >= 100]) > 0.95


def test_mixing_against_plain_projected_gradient(spark):
    """Rates of soft members, found again by plain least squares under r >= 0 in the variables sqrt(n) r."""
    rng = np.random.default_rng(9)
    p = rng.dirichlet((0.4, 0.6, 0.5), 60)
    n = rng.integers(5, 200, 60)
    frame = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "n long, p0 double, p1 double, p2 double")
    want = np.array([0.2, 0.5, 0.3]) * n.sum()
    steps, totals = mixing.fit(frame, ["p0", "p1", "p2"], None, [0.2, 0.5, 0.3])
    rate = np.array([r[0] for r in frame.select(mixing._rate(steps, ["p0", "p1", "p2"])).collect()])
    assert np.allclose(totals, (n[:, None] * p).sum(axis=0)) and (rate >= 0).all()
    assert np.abs((rate * n) @ p - want).max() < 1e-4 * n.sum()
    plain, inner = np.ones(60), (p * n[:, None]).T @ p
    for _ in range(2000):
        plain = np.maximum(0, plain + p @ np.linalg.solve(inner, want - (plain * n) @ p))
    assert np.abs((plain * n) @ p - want).max() < 1e-4 * n.sum() and np.allclose(plain, rate, atol=1e-2)


def test_mixing_keeps_clean_texts_of_rare_words(spark):
    """Half of the texts are in a language of compounds, nearly all of its words rare; a few words alone tell toxic ones."""
    rng = np.random.default_rng(8)
    parts = ["".join(rng.choice(list("abcdefghijklmnop"), 3)) for _ in range(60)]
    rows = []
    for i in range(400):
        domain = ("clean", "toxic")[i % 8 < 2]
        words = ["".join(rng.choice(parts, 3)) for _ in range(150)] if i % 2 else list(rng.choice("the of and to in on sun sea hill".split(), 150))
        if domain == "toxic":
            words[::20] = rng.choice("scum moron trash".split(), len(words[::20]))
        rows.append((i, " ".join(words), domain))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, d) for i, _, d in rows if i < 200], "id bigint, domain string")
    kept = {r.doc_id for r in mixing.drawn(df, labels, ("clean", "toxic"), (1.0, 0.0)).collect()}
    assert kept == {i for i, _, d in rows if d == "clean"}


def brute_spans(texts, length, keep):
    seen, count = set(), Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for i in sorted(texts):
        t, mark = texts[i], bytearray(len(texts[i]))
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if (w in seen) if keep == "first" else count[w] > 1:
                mark[s : s + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(t), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(bytes(x for x, m in zip(t, mark, strict=True) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("keep, crowd", [("none", 4096), ("first", 4096), ("none", 1), ("first", 1)])
def test_repeated_substrings(docs, plain, keep, crowd):
    want = brute_spans({i: t.encode() for i, t in plain.items()}, 400, keep)
    got = substrings.repeated_substrings(docs, keep=keep, crowd=crowd)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == want
    assert any(w[1] for w in want.values())


@pytest.mark.parametrize("crowd", [4096, 1])
def test_passages_and_awkward_rows(spark, crowd):
    """Null and repeated ids are texts of their own; passages are in several texts, repeats within one are none."""
    one, two, alone = prose(90, 61), prose(70, 62), prose(60, 63)
    inner = " ".join(one.split()[20:45])
    rows = [(None, one), (None, prose(20, 64) + " " + inner + " " + prose(20, 65)), (4, two), (4, "x " + two), (6, alone + "\n" + alone), (7, "long " * 3000), (8, None), (None, prose(30, 66)), (9, two), (9, two)]
    length, least, words = 60, 40, 12
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for w in (length, least):
        for r, t in enumerate(raw):
            for i in range(len(t) - w + 1):
                seen.setdefault(t[i : i + w], []).append(r)
    same = {k: rows[k] for k in range(len(rows))}
    want = []
    for r, t in enumerate(raw):
        marks = []
        for w, hit in ((length, lambda at, r: len(at) > 1), (least, lambda at, r: len({same[k] for k in at}) > 1)):
            mark = bytearray(len(t))
            for i in range(len(t) - w + 1):
                if hit(seen[t[i : i + w]], r):
                    mark[i : i + w] = b"\1" * w
            marks.append(bytes(mark))
        spans = [m.span() for m in re.finditer(b"\1+", marks[1])]
        whole = [sum(lo <= m.start() and m.end() <= hi for m in re.finditer(rb"\S+", t)) for lo, hi in spans]
        want.append((rows[r][0] or 0, len(t), sum(marks[0]), sum(n > words for n in whole)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substrings.repeated_substrings(df, length=length, passage=least, words=words, crowd=crowd).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_passages) for r in got) == sorted(want)
    assert {w[3] for w in want} == {0, 1} and any(w[2] for w in want if w[0] == 6)


def test_longest_previous_factors():
    rng = np.random.default_rng(7)
    contexts = [bytes(rng.choice(list(b"ab"), 40).astype(np.uint8)) for _ in range(6)]
    factors = substrings.Factors(contexts, 12)
    text, at = [], []
    for k, c in enumerate(contexts):
        for i in range(len(c) - 11):
            text.append(c[i : i + 12])
            at.append((k, i))
    common = lambda a, b: next((n for n in range(12) if a[n] != b[n]), 12)
    assert factors.previous().tolist() == [max((common(t, u) for u in text[:i]), default=0) for i, t in enumerate(text)]
    assert factors.following().tolist() == [max((common(t, u) for u in text[i + 1 :]), default=0) for i, t in enumerate(text)]


def test_substrings_of_nothing(docs):
    assert substrings.repeated_substrings(docs.filter("false")).count() == 0


def test_segmentations_round_trip_and_differ(docs, plain):
    vocab = segment.vocabulary(segment.MODEL, 1.0)
    rows = segment.sampled_segmentations(docs, samples=4).collect()
    assert len(rows) == len(plain)
    for r in rows:
        ids = [tuple(s.ids) for s in r.samples]
        assert len(set(ids)) == len(ids) and [s.g for s in r.samples] == sorted((s.g for s in r.samples), reverse=True)
        assert all(segment._joined(vocab, np.array(s.ids, np.int64)).decode() == plain[r.doc_id] for s in r.samples)
    back = segment.decoded(docs.select("doc_id").limit(1).select("doc_id", F.lit(None).cast("array<int>").alias("ids")))
    assert back.first().text is None


def test_every_sample_is_decoded(spark, docs, plain):
    for r in corpus_pipeline.pieces(spark, docs, "").collect():
        assert r.n_samples == len(r.samples) > 0
        assert {s.decoded_sha256 for s in r.samples} == {hashlib.sha256(plain[r.doc_id].encode()).hexdigest()}


def test_sampling_has_the_right_chances():
    vocab, n = segment.vocabulary(segment.MODEL, 1.0), 4000
    raw = b" then"
    pieces, found = {vocab.raw[i]: i for i in vocab.ids}, []

    def extend(at, ids, score):
        if at == len(raw):
            found.append((tuple(ids), score))
        for end in range(at + 1, len(raw) + 1):
            if raw[at:end] in pieces:
                extend(end, [*ids, pieces[raw[at:end]]], score + vocab.score[pieces[raw[at:end]]])

    extend(0, [], 0.0)
    z = np.logaddexp.reduce([s for _, s in found])
    chance = {k: math.exp(s - z) for k, s in found}
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["then"] * n), pa.array(range(n), pa.int64())], names=["id", "text", "key"])
    samples = [x for b in segment._encode(2, 1, segment.MODEL, 1.0)(iter([batch])) for x in b.column("samples").to_pylist()]
    first, both = Counter(tuple(s[0]["ids"]) for s in samples), Counter(tuple(x["ids"]) for s in samples for x in s)
    for k, p in chance.items():
        either = p + sum(q * p / (1 - q) for j, q in chance.items() if j != k)
        assert abs(first[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        assert abs(both[k] / n - either) < 5 * math.sqrt(either * max(0, 1 - either) / n) + 2e-3
    estimate = np.mean([sum(math.exp(x["log_chance"]) / x["inclusion"] for x in s) for s in samples])
    assert abs(estimate - 1) < 0.01


def best_repair(roles):
    """Least cost over all states, turn by turn."""
    costs = {"start": 0}
    for role in roles:
        after = {}
        for s, c in costs.items():
            for t in chat.STATES:
                move = chat.MOVES[role][chat.STATES.index(s)][chat.STATES.index(t)]
                if move:
                    after[t] = min(after.get(t, 10**9), c + move[0])
        costs = after
    return min(c + chat.ENDINGS[s][0] for s, c in costs.items())


def test_chat_repair(spark):
    chats = {
        1: ["system", "user", "assistant"], 2: ["user", "user", "assistant", "assistant"], 3: ["assistant"], 4: ["bot", "user", "user"], 5: ["user", "system", "assistant"], 6: [None, "assistant", "user"],
        7: ["user", "assistant"] * 9 + ["assistant", "user", "user"] * 3,
    }
    rows = [(c, i, r, f"t{c}.{i}", "x") for c, roles in chats.items() for i, r in enumerate(roles)]
    df = spark.createDataFrame(rows + rows[:3] + [(8, 0, " User ", None, "x")], "conv_id bigint, turn bigint, role string, text string, cost string")
    for block in (4096, 4):
        got = chat.repair_chats(df, block=block).orderBy("conv_id", "place").collect()
        for c, roles in chats.items():
            mine = [r for r in got if r.conv_id == c]
            known = [r if r in chat.ROLES else None for r in roles]
            assert mine[0].cost == best_repair(known)
            text = "".join(r.rendered for r in mine)
            turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
            spoken = [t for t, _ in turns]
            spoken = spoken[1:] if spoken[0] == "system" else spoken
            assert spoken == ["user", "assistant"] * (len(spoken) // 2) and spoken
            assert [x for _, t in turns for x in re.findall(r"t[\d.]+", t)] == [f"t{c}.{i}" for i in range(len(roles))]
            assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) == text
    assert chat.repair_chats(df.filter("false")).count() == 0


def test_chat_null_and_negative_turns(spark):
    """Null turns come first, before negative ones, also where blocks are small; a null conversation is one."""
    rows = [(1, -3, "assistant", "b"), (1, None, "user", "a"), (1, 9, "assistant", "d"), (1, 4, "user", "c"), (None, 0, "user", "x"), (None, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for block in (4096, 2):
        got = chat.repair_chats(df, block=block).orderBy("conv_id", "place").collect()
        assert ["".join(x) for x in ([r.rendered for r in got if r.conv_id == c] for c in (1, None))] == ["".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) for turns in ([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], [("user", "x"), ("assistant", "")])]


def test_licences(spark):
    rows = [
        (0, "a/LICENSE", "Released under the MIT License."), (1, "a/b/x.py", "code"), (2, "a/b/c/y.py", "text\nLicensed under the Apache License, Version 2.0.\nmore"), (3, "z/w.py", None), (4, "a/b/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (5, "a/b/c/d/e.py", "a word of permission"), (6, None, "plain"), (7, "a/b/x.py", "code"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("own", F.lit("clash"))
    got = {r.doc_id: (r.own, r.licence, r.via, r.from_dir) for r in licences.licences(df, "doc_id", "path", "text", F.col("path").endswith("LICENSE")).collect()}
    assert got == {
        0: ("MIT", "MIT", "own", None), 1: (None, "MIT", "inherited", "a"), 2: ("Apache-2.0", "Apache-2.0", "own", None), 3: (None, None, "none", None), 4: ("GPL-3.0", "GPL-3.0", "own", None),
        5: (None, "GPL-3.0", "inherited", "a/b/c"), 6: (None, None, "none", None), 7: (None, "MIT", "inherited", "a"),
    }
    assert licences.licences(df.filter("false"), "doc_id", "path", "text", F.lit(True)).count() == 0


def test_licence_scores_against_plain_cosines(spark):
    """Headers over several lines, whole files, null ids, and a line of 100,000 words."""
    apache, mit = licences.TEMPLATES["Apache-2.0"][2], licences.TEMPLATES["MIT"][4]
    header = "# Copyright 2020 The Authors\n# " + apache.replace(". ", ".\n# ")
    rows = [(1, "p/a.py", header + "\n\nimport os\n"), (2, "p/LICENSE", mit), (None, "p/q/b.py", "x"), (4, "p/c.py", "licensed " + "word " * 100_000), (None, "p/LICENSE", "permission")]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = sorted(licences.licences(df, "doc_id", "path", "text", F.col("path").endswith("LICENSE")).collect(), key=lambda r: (r.doc_id or 0, r.path))
    units = {}
    for k, (_, path, text) in enumerate(rows):
        own = [x for x in [*text.split("\n"), *re.split(r"\n\s*\n", text), *([text] if path.endswith("LICENSE") else [])] if re.search(licences.SIGNS, x)]
        units[k] = list(dict.fromkeys(own))
    every = [re.findall(licences.TOKEN, u.lower()) for own in units.values() for u in own]
    inverse = lambda t: math.log((1 + len(every)) / (1 + sum(t in x for x in every))) + 1
    known = {t for all_said in licences.TEMPLATES.values() for said in all_said for t in re.findall(licences.TOKEN, said.lower())}
    best = {}
    for k, own in units.items():
        best[k] = 0.0
        for u in own:
            a = {t: n * (inverse(t) if t in known else math.log(1 + len(every)) + 1) for t, n in Counter(re.findall(licences.TOKEN, u.lower())).items()}
            for all_said in licences.TEMPLATES.values():
                for said in all_said:
                    b = {t: n * inverse(t) for t, n in Counter(re.findall(licences.TOKEN, said.lower())).items()}
                    best[k] = max(best[k], sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
    assert [round(r.score, 9) for r in sorted(got, key=lambda r: [x[:2] for x in rows].index((r.doc_id, r.path)))] == [round(best[k], 9) for k in range(5)]
    assert {(r.doc_id, r.path): (r.own, r.licence) for r in got} == {(1, "p/a.py"): ("Apache-2.0",) * 2, (2, "p/LICENSE"): ("MIT",) * 2, (None, "p/q/b.py"): (None, "MIT"), (4, "p/c.py"): (None, "MIT"), (None, "p/LICENSE"): (None, "MIT")}


def test_substrings_of_one_anchor_are_compared_in_bands(monkeypatch):
    monkeypatch.setattr(substrings, "GRAM", 3)
    length, passage, r = 14, 9, random.Random(4)
    blocks = ["".join(r.choices("abc", k=12)) + "xyz" + "".join(r.choices("abc", k=12)) for _ in range(9)]
    texts = ["".join(r.choices(blocks + ["ba", "c"], k=4)) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(60), pa.int64()), "x": pa.array([0] * 60, pa.int64()), "text": texts})
    held = {}
    for row in (x for b in substrings._runs(length, passage)(iter([batch])) for x in b.to_pylist()):
        held.setdefault((row["anchor"], row["context"]), []).append(row)
    rows = []
    for (anchor, context), of in sorted(held.items(), key=lambda kv: (kv[0][0], min((x["id"], x["start"]) for x in kv[1]))):
        first = min(of, key=lambda x: (x["id"], x["start"]))
        rows.append({"anchor": anchor, "context": context, "bytes": texts[first["id"]].encode()[first["start"] : first["start"] + first["n"] - 1 + length], "lo": min(x["id"] for x in of), "hi": max(x["id"] for x in of), "n": first["n"]})
    counts, factors = [], substrings.Factors

    def seen(contexts, depth, windows):
        counts.append(sum(windows))
        return factors(contexts, depth, windows)

    monkeypatch.setattr(substrings, "Factors", seen)
    for keep in ("none", "first"):
        got = {}
        for most in (1 << 18, 20):
            counts.clear()
            monkeypatch.setattr(substrings, "SUFFIXES", most, raising=False)
            out = substrings._compared(length, passage, keep)(iter([pa.RecordBatch.from_pylist(rows)]))
            got[most] = [x for b in out for x in b.to_pylist()]
        assert got[20] == got[1 << 18] and any(x["found"] for x in got[20])
        # One place of an anchor at a time at least: one window of each of its contexts.
        assert max(counts) <= max(20, max(sum(x["anchor"] == a["anchor"] for x in rows) for a in rows)) < sum(x["n"] for x in rows)


def test_substrings_make_objects_of_few_rows_at_once(monkeypatch):
    monkeypatch.setattr(substrings, "PORTION", 1 << 14, raising=False)
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("passage", pa.bool_())]))
    marks = [None if i % 3 else [{"lo": 1 + i % 5, "hi": 3 + i % 5, "passage": False}] for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(["abcdefgh" * 20] * 300), pa.array(marks, kind)], names=["id", "text", "marks"])
    out = list(substrings._result(4, 4, 9, False)(iter([batch, batch.slice(0, 0)])))
    assert len(out) > 4 and [x for b in out for x in b.column("id").to_pylist()] == list(range(300))
    assert [x for b in out for x in b.column("n_removed").to_pylist()] == [0 if m is None else 5 for m in marks]


def test_units_are_solved_once_for_many_batches(monkeypatch):
    solved, lattices = [], segment.Lattices

    class Seen(lattices):
        def __init__(self, vocab, data, starts, sizes):
            solved.append(len(sizes))
            super().__init__(vocab, data, starts, sizes)

    monkeypatch.setattr(segment, "Lattices", Seen)
    texts = [t or "" for t in TEXTS]

    def sampled(step, most):
        if hasattr(segment, "Kept"):
            segment.kept.cache_clear()
            monkeypatch.setattr(segment.Kept.__init__, "__defaults__", (most,))
        solved.clear()
        batches = [pa.RecordBatch.from_pydict({"id": list(range(k, k + len(part))), "text": part, "key": pa.array(range(k, k + len(part)), pa.int64())}) for k in range(0, len(texts), step) for part in (texts[k : k + step],)]
        return [(x["id"], [(s["ids"], s["decoded_sha256"]) for s in x["samples"]], x["decoded_sha256"]) for b in segment._encode(3, 1, segment.MODEL, segment.TEMPER)(iter(batches)) for x in b.to_pylist()]

    want = sampled(len(texts), 1 << 20)
    once = sum(solved)
    assert sampled(2, 1 << 20) == want and sum(solved) == once
    assert sampled(2, 3000) == want and sum(solved) > once
    assert sampled(2, 10) == want
    segment.kept.cache_clear()


def test_select_reads_words_not_bits():
    rng = np.random.default_rng(11)
    words = np.concatenate([rng.integers(0, 2**64, 300, np.uint64, endpoint=False), rng.integers(0, 2**64, 100, np.uint64, endpoint=False) & rng.integers(0, 2**64, 100, np.uint64, endpoint=False) & np.uint64(0xFF00000000000081), np.array([1, 1 << 63, 2**64 - 1, 0x8000000000000001], np.uint64)])
    ones = [(w, k, p) for w in words.tolist() for k, p in enumerate(i for i in range(64) if w >> i & 1)]
    w, k, p = (np.array(x, t) for x, t in zip(zip(*ones, strict=True), (np.uint64, np.int64, np.int64), strict=True))
    assert elias_fano.select(w, k).tolist() == p.tolist()
