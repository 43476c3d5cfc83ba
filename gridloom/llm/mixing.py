"""Rates at which documents are drawn, so that the expected tokens of each domain meet their targets.

A classifier learned from a labelled table gives each document the probabilities of its domains;
a document belongs to each of them by that much. With n its words and p its probabilities, rates r
are sought that are not negative and bring sum(r * n * p) to the targets, by projected gradient
descent from r = 1 on the least squares of the gaps:

    r <- max(0, r + step . p),   step = size * inverse(sum(n * p p')) (targets - sum(r * n * p))

which is the gradient in the variables sqrt(n) * r, scaled by the inverse of the products of the
domains over the documents that can still move either way; a step that gains nothing is halved.
An iteration is one distributed sum of few numbers, by the domains and their pairs. The steps are few and small, so a rate is an expression over a document's own
probabilities, and no table of rates has to be kept or joined.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, cut, text_of

#: A word counts only if its documents tell two domains apart by so much: twice the log of how much likelier they are with a chance for each domain than with a shared one.
SURE = 10.0
#: Labelled rows that the classifier learns from, at most: those of the least hashes of their ids.
SAMPLE = 20_000
#: Marks that don't belong to the word before or after them.
MARKS = ".,;:!?\"'()"
#: Of the classifier's descent: passes over the sample, rows of a step, its first size, and what draws weights to zero.
EPOCHS, STEP_ROWS, STEP_SIZE, SHRINK = 40, 256, 0.05, 1e-4
ROUNDS = 25
CLOSE = 1e-6


@dataclass
class Classifier:
    """Logistic regression over which of the words that tell domains apart a text has, as log odds against domain 0.

    bias[k]; words: a table in which the hash of each such word is at one of its two places, of a
    length that is a power of two; weight[k][place]. Words that go together, as those of a language
    do, share what they tell; counted one by one they would outweigh the few that do tell.
    """

    domains: Sequence[str]
    bias: list[float]
    words: list[int | None]
    weight: list[list[float]]


def _hashes(text: Column) -> Column:
    """A hash for each word, without marks around it; one null for a text without words."""
    words = F.split(F.btrim(F.lower(text), F.lit(SPACE_CHARS)), SPACES)
    return F.transform(words, lambda w: F.when(w != "", F.xxhash64(F.btrim(w, F.lit(MARKS)))))


def _table(keys: Sequence[int]) -> list[int | None]:
    """Each key at one of its two places, by its low bits or by those above the lowest 32: a cuckoo hash a quarter full."""
    size = 16
    while size < 4 * len(keys):
        size *= 2
    while True:
        table: list[int | None] = [None] * size
        for key in keys:
            held, at = key, key & (size - 1)
            for _ in range(100):
                held, table[at] = table[at], held
                if held is None:
                    break
                one, two = held & (size - 1), (held >> 32) & (size - 1)
                at = two if at == one else one
            if held is not None:
                break
        else:
            return table
        size *= 2


def _told(docs: Column, docs0: Column, n: int, n0: int) -> Column:
    """How surely a word tells a domain of n documents, docs of them with it, from one of n0 (see SURE)."""

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    chance = (docs + docs0) / max(n + n0, 1)
    return 2 * (term(docs, n * chance) + term(docs0, n0 * chance) + term(n - docs, n * (1 - chance)) + term(n0 - docs0, n0 * (1 - chance)))


def regression(rows: list[Sequence[int]], domain: np.ndarray, words: int, domains: int) -> np.ndarray:
    """Weights (words + 1, domains), the last row the biases: logistic regression by descent with steps of each weight's own size, in a fixed order.

    rows: of each text the words it has.
    """
    sizes = np.array([len(r) for r in rows])
    flat, start = np.array([w for r in rows for w in r], np.int64), np.cumsum(sizes) - sizes
    weight = np.zeros((words + 1, domains))
    weight[words] = np.log((np.bincount(domain, minlength=domains) + 1) / (len(rows) + domains))
    mean, square, t, rng = np.zeros_like(weight), np.zeros_like(weight), 0, np.random.default_rng(1)
    for epoch in range(EPOCHS):
        order, size = rng.permutation(len(rows)), STEP_SIZE * (1 - epoch / EPOCHS)
        for some in np.array_split(order, -(-len(rows) // STEP_ROWS)):
            row = np.repeat(np.arange(len(some)), sizes[some])
            word = flat[np.arange(len(row)) + np.repeat(start[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some])]
            score = weight[words] + np.stack([np.bincount(row, weight[word, k], len(some)) for k in range(domains)], axis=1)
            off = np.exp(score - score.max(axis=1, keepdims=True))
            off /= off.sum(axis=1, keepdims=True)
            off[np.arange(len(some)), domain[some]] -= 1
            off /= len(some)
            slope = np.stack([np.append(np.bincount(word, off[row, k], words), off[:, k].sum()) for k in range(domains)], axis=1)
            slope[:words] += SHRINK * weight[:words]
            t += 1
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
            weight -= size * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return weight


def learn(df: DataFrame, labels: DataFrame, domains: Sequence[str], id_col: str, text_col: str, sample: int = SAMPLE) -> Classifier:
    """labels: id and domain. The sample, drawn of the labels whose ids df has, has `sample` rows at most: it is broadcast, and the driver learns from its telling words. Ids in two domains count for the lesser."""
    k = len(domains)
    known = labels.filter(F.col("domain").isin(list(domains)) & F.col("id").isNotNull()).groupBy("id").agg(F.min("domain").alias("domain"))
    known = known.join(df.select(F.col(id_col).alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = cut(rows.select("domain", F.array_distinct(F.array_compact(_hashes(F.col("text")))).alias("hashes")))
    sizes = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    sizes = [sizes.get(d, 0) for d in domains]
    prior = [math.log((n + 1) / (sizes[0] + 1)) for n in sizes]
    nothing = Classifier(domains, prior, [None], [[0.0]] * k)
    if k < 2 or not sum(sizes):
        return nothing
    wide = rows.select("domain", F.explode("hashes").alias("word")).groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"d{i}") for i, d in enumerate(domains)])
    told = F.greatest(F.lit(0.0), *[_told(F.col(f"d{i}"), F.col("d0"), sizes[i], sizes[0]) for i in range(1, k)])
    sure = [r[0] for r in wide.filter(told > SURE).select("word").orderBy("word").collect()]  # words of several labelled documents each
    if not sure:
        return nothing
    words = _table(sure)
    texts = rows.select("domain", known_words(Classifier(domains, prior, words, [])).alias("places")).collect()  # `sample` rows at most
    texts.sort(key=lambda r: (r["domain"], r["places"]))
    weight = regression([r["places"] for r in texts], np.array([list(domains).index(r["domain"]) for r in texts]), len(words), k)
    weight = np.round(weight - weight[:, :1], 6)
    return Classifier(domains, [float(x) for x in weight[-1]], words, [[float(x) for x in weight[:-1, i]] for i in range(k)])


def known_words(classifier: Classifier, hashes: str = "hashes") -> Column:
    """The places of those hashes that the classifier has, each once."""
    table = F.from_json(F.lit(json.dumps(classifier.words)), "array<bigint>")
    last = F.lit(len(classifier.words) - 1).cast("long")

    def place(h: Column) -> Column:
        one, two = h.bitwiseAND(last).cast("int"), F.shiftrightunsigned(h, 32).bitwiseAND(last).cast("int")
        return F.when(F.get(table, one) == h, one).when(F.get(table, two) == h, two)

    return F.array_distinct(F.array_compact(F.transform(hashes, place)))


def log_odds(classifier: Classifier, places: str = "places") -> list[Column]:
    """Log odds of each domain but the first, over the column of places."""

    def of(k: int) -> Column:
        weights = F.from_json(F.lit(json.dumps(classifier.weight[k])), "array<double>")
        return F.aggregate(places, F.lit(classifier.bias[k]), lambda s, p: s + F.get(weights, p))

    return [of(k) for k in range(1, len(classifier.domains))]


def _members(df: DataFrame, text_col: str, classifier: Classifier, carried: list[str]) -> tuple[DataFrame, list[str]]:
    """The carried columns as the struct `row`, n and each domain's probability p0, p1 ..."""
    k = len(classifier.domains)
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), _hashes(text_of(text_col)).alias("hashes"))
    n = F.when(F.get("hashes", F.lit(0)).isNull(), 0).otherwise(F.size("hashes")).cast("long")
    df = df.select("row", n.alias("n"), known_words(classifier).alias("places"))
    df = df.select("row", "n", F.lit(0.0).alias("o0"), *[o.alias(f"o{i + 1}") for i, o in enumerate(log_odds(classifier))])
    top = F.greatest(*[F.col(f"o{i}") for i in range(k)]) if k > 1 else F.col("o0")
    df = df.select("row", "n", *[F.exp(F.col(f"o{i}") - top).alias(f"e{i}") for i in range(k)])
    total = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    return df.select("row", "n", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in range(k)]), [f"p{i}" for i in range(k)]


def _rate(steps: list[list[float]], names: list[str]) -> Column:
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate + sum((F.lit(x) * F.col(p) for x, p in zip(step[1:], names[1:], strict=True)), F.lit(step[0]) * F.col(names[0])))
    return rate


def fit(members: DataFrame, names: list[str], factors: Sequence[float] | None, shares: Sequence[float] | None, rounds: int = ROUNDS) -> tuple[list[list[float]], list[float]]:
    """Steps of the descent, and the domains' tokens at rate 1. shares: of all tokens; or factors, by which the targets are what the domains
    have if each document comes as often as its likeliest domain's factor says: so much can be met, while none of a domain can't, of which
    every document has a little. Warns of totals that still move after the last round."""
    k = len(names)
    sums = [F.sum(F.col("n") * F.col(p)).alias(p) for p in names]
    top, factor = F.greatest(*names) if k > 1 else F.col(names[0]), F.lit(None).cast("double")
    for p, x in list(zip(names, factors or [], strict=False))[::-1]:
        factor = F.when(F.col(p) == top, float(x)).otherwise(factor)
    sums += [F.sum(F.col("n") * F.col(p) * factor).alias(f"want_{p}") for p in names]
    first = members.agg(*sums, *[F.sum(F.col("n") * F.col(a) * F.col(b)).alias(f"{a}{b}") for a in names for b in names]).first()
    totals = np.array([first[p] or 0.0 for p in names])
    want = np.array([first[f"want_{p}"] or 0.0 for p in names]) if factors is not None else totals.sum() * np.array(shares)
    inner = np.array([[first[f"{a}{b}"] or 0.0 for b in names] for a in names])
    steps, now, size, close = [], totals, 1.0, CLOSE * max(1.0, totals.sum())
    for _ in range(rounds):
        gap = want - now
        if np.abs(gap).max(initial=0) <= close or size < CLOSE:
            return steps, [float(x) for x in totals]
        step = [float(x) for x in size * (np.linalg.pinv(inner + 1e-9 * max(1.0, np.trace(inner)) * np.eye(k)) @ gap)]
        at = members.select(_rate([*steps, step], names).alias("rate"), "n", *names)
        free = [F.sum(F.when(F.col("rate") > 0, F.col("n") * F.col(a) * F.col(b))).alias(f"{a}{b}") for a in names for b in names]
        got = at.agg(*[F.sum(F.col("rate") * F.col("n") * F.col(p)).alias(p) for p in names], *free).first()
        then = np.array([got[p] or 0.0 for p in names])
        gained = np.linalg.norm(gap) - np.linalg.norm(want - then)
        if gained <= 0:
            size /= 2
            continue
        steps.append(step)
        now, size, inner = then, min(1.0, 2 * size), np.array([[got[f"{a}{b}"] or 0.0 for b in names] for a in names])
        if gained <= close * CLOSE:
            return steps, [float(x) for x in totals]
    if rounds:
        warnings.warn(f"the tokens still move after {rounds} rounds; their gaps to the targets: {(want - now).round(3).tolist()}", stacklevel=2)
    return steps, [float(x) for x in totals]


def mix_rates(df: DataFrame, labels: DataFrame, domains: Sequence[str], shares: Sequence[float], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of df: id, n_tokens, p_<domain> of each domain, domain (the likeliest), rate.

    labels: id, domain; labels of other domains, null ones and those of unknown ids teach nothing,
    and without any all domains are as likely. shares: each domain's part of the tokens of df, by
    words. A null or empty text has no tokens, the prior's probabilities, and a rate that moves
    nothing. Repeated rows each have their rate. Ties between domains go to the first. Targets that
    no rates can meet are met as closely as their least squares allow. An empty table gives an
    empty result; null ids are carried. Other columns of df are not read.
    """
    classifier = learn(df, labels, domains, id_col, text_col, sample)
    members, names = _members(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", classifier, ["id"])
    members = cut(members)
    steps, _ = fit(members, names, None, shares)
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    likeliest = F.lit(domains[-1])
    for d, p in list(zip(domains, names, strict=True))[-2::-1]:
        likeliest = F.when(F.col(p) == top, d).otherwise(likeliest)
    return members.select(F.col("row.id").alias(id_col), F.col("n").alias("n_tokens"), *[F.col(p).alias(f"p_{d}") for d, p in zip(domains, names, strict=True)], likeliest.alias("domain"), _rate(steps, names).alias("rate"))


def drawn(df: DataFrame, labels: DataFrame, domains: Sequence[str], factors: Sequence[float], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, unbiased: bool = False) -> DataFrame:
    """The rows of df, each as often as its rate says, with all of their columns; shuffles no text.

    factors: how often documents of each domain are wanted; the targets are the tokens that follow. A rate becomes a whole number of
    copies: the nearest, or, if unbiased, the floor of the rate and a fraction hashed from the id.
    The nearest keeps a document that is more of the wanted domains than not as it is, where the
    other would drop it by as much as it is not. Texts without words move nothing and come once
    unless the prior's rate says otherwise; null ids, ties, repeated and no rows are as in
    mix_rates.
    """
    classifier = learn(df, labels, domains, id_col, text_col, sample)
    members, names = _members(df, text_col, classifier, df.columns)
    members = cut(members)
    steps, _ = fit(members, names, factors, None)
    fraction = F.pmod(F.xxhash64(F.col(f"row.`{id_col}`"), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30) if unbiased else F.lit(0.5)
    copies = F.floor(_rate(steps, names) + fraction).cast("int")
    return members.select(F.explode(F.array_repeat("row", copies)).alias("row")).select("row.*")
