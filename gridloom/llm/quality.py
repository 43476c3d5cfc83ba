"""Quality rules that vote or abstain, weighed by what expectation-maximisation learns of them.

One pass turns each text into counts, inside the row and without a shuffle. Each rule reads the
counts and votes +1 (good), -1 (bad) or 0 (abstains). The votes of all documents are summed up as
a histogram of vote patterns, which has at most 3 ** len(RULES) rows however many documents there
are; expectation-maximisation runs on that histogram and estimates, for a good and for a bad
document, how often each rule votes what. A document's posterior then is an expression over its
own votes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, UPPER, cut, text_of, words_of

# The contract's symbols and base limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: What the rules look at: a share each, null where there is nothing to divide by.
SHARES = {
    "symbols": ("n_symbols", "n_words"), "capitals": ("n_upper", "word_chars"), "exclaims": ("n_exclaim", "n_words"), "lines": ("n_dup_lines", "n_lines"),
    "windows": ("n_repeat_words", "n_words"), "length": ("word_chars", "n_words"), "variety": ("n_distinct", "n_words"),
}
#: name: votes bad if, votes good if. A rule that sees no sign of its own abstains.
RULES = {
    "symbols": (lambda s: s["symbols"] > 0.25, None),
    "capitals": (lambda s: s["capitals"] > 0.5, None),
    "exclaims": (lambda s: s["exclaims"] > 0.5, None),
    "lines": (lambda s: s["lines"] > 0.4, None),
    "windows": (lambda s: s["windows"] > 0.4, None),
    "length": (lambda s: (s["length"] < 2.5) | (s["length"] > 14), None),
    "prose": (None, lambda s: (s["symbols"] < 0.1) & (s["capitals"] < 0.3) & (s["exclaims"] < 0.2) & (s["length"] > 3) & (s["length"] < 10)),
    "novelty": (lambda s: s["variety"] < 0.05, lambda s: (s["lines"] < 0.2) & (s["windows"] < 0.2)),
}
#: Beliefs that expectation-maximisation starts from and is held to: chances of the votes bad, none, good.
FLAGS = {0: (0.35, 0.6, 0.05), 1: (0.01, 0.97, 0.02)}
PRAISES = {0: (0.3, 0.5, 0.2), 1: (0.01, 0.09, 0.9)}
#: The beliefs weigh as much as this share of the documents.
HOLD = 0.02
#: A rule never speaks against more than this share of the good documents: what tells the two classes apart.
FALSE_ALARMS = 0.01
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_distinct")


def _belief(cls: int) -> list[tuple[float, ...]]:
    return [(FLAGS if good is None else PRAISES)[cls] for _, good in RULES.values()]


@dataclass
class Model:
    """chance[cls][rule][vote + 1] for the classes bad 0 and good 1; prior of good."""

    prior: float = 0.8
    chance: list[list[tuple[float, ...]]] = field(default_factory=lambda: [_belief(0), _belief(1)])

    def log_odds(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.prior) - math.log1p(-self.prior)
        return odds + sum(math.log(self.chance[1][r][v + 1]) - math.log(self.chance[0][r][v + 1]) for r, v in enumerate(votes))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _counted(df: DataFrame, text_col: str, carried: list[str]) -> DataFrame:
    """The carried columns as the struct `row`, and the counts of the text."""
    text = text_of(text_col)
    size = F.length("text")
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), text.alias("text"))
    df = df.select(
        "row",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: _without(x, SPACE_CHARS) > 0).alias("lines"),
        _without(F.col("text"), SPACE_CHARS).alias("word_chars"),
        *[(size - _without(F.col("text"), chars)).alias(name) for name, chars in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_exclaim", "!"))],
    )
    n = F.size("words")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    df = df.select(
        "row", "word_chars", "n_symbols", "n_upper", "n_exclaim", n.alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # Only texts that repeat a window pay for the sort that finds where.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")

    def place(x: Column, j: Column) -> Column:
        same = lambda at: F.coalesce(F.get("sorted", at)["h"] == x["h"], F.lit(False))
        return F.when(same(j - 1) | same(j + 1), x["i"])

    found = F.filter(F.transform("sorted", place), lambda i: i.isNotNull())
    covered = F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2))))
    df = df.withColumn("n_repeat_words", F.when(F.col("sorted").isNull(), 0).otherwise(F.size(covered)))
    return df.select("row", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def _voted(df: DataFrame) -> DataFrame:
    shares = {name: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for name, (a, b) in SHARES.items()}

    def vote(name: str) -> Column:
        bad, good = ((rule(shares) if rule else F.lit(False)) for rule in RULES[name])
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int").alias(f"vote_{name}")

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select("*", *[vote(name) for name in RULES], failed.alias("base_failed"))


def fit(voted: DataFrame, rounds: int = 50) -> Model:
    """Expectation-maximisation over the histogram of vote patterns: bounded by the number of rules."""
    patterns = [(tuple(x[:-1]), x[-1]) for x in voted.groupBy(*[f"vote_{name}" for name in RULES]).count().collect()]
    model, total = Model(), sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(v))))) for v, _ in patterns]
        mass, hold = sum(p * n for p, (_, n) in zip(good, patterns, strict=True)), max(1.0, HOLD * total)
        model = Model((mass + 0.8 * hold) / (total + hold))
        for cls, weights in ((1, good), (0, [1 - p for p in good])):
            held = sum(w * n for w, (_, n) in zip(weights, patterns, strict=True))
            for r, belief in enumerate(_belief(cls)):
                seen = [sum(w * n for w, (v, n) in zip(weights, patterns, strict=True) if v[r] + 1 == k) for k in range(3)]
                chance = [(seen[k] + hold * belief[k]) / (held + hold) for k in range(3)]
                if cls and chance[0] > FALSE_ALARMS:
                    chance = [FALSE_ALARMS, *(x * (1 - FALSE_ALARMS) / (1 - chance[0]) for x in chance[1:])]
                model.chance[cls][r] = tuple(chance)
    return model


def _judged(voted: DataFrame, model: Model, threshold: float) -> DataFrame:
    odds = F.lit(math.log(model.prior) - math.log1p(-model.prior))
    for r, rule in enumerate(RULES):
        weigh = [math.log(model.chance[1][r][k]) - math.log(model.chance[0][r][k]) for k in range(3)]
        vote = F.col(f"vote_{rule}")
        odds = odds + F.when(vote < 0, weigh[0]).when(vote > 0, weigh[2]).otherwise(weigh[1])
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds))))
    return voted.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of df: id, counts, votes, base_failed, posterior, kept.

    A null text has no words. Texts without words fail the base and leave every rule that divides
    by words abstaining. Repeated rows are judged alike and each counts as evidence. An empty table
    gives an empty result. A null id is carried. Other columns of df are not read.
    """
    voted = cut(_voted(_counted(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"])))
    judged = _judged(voted, fit(voted), threshold)
    votes = [f"vote_{name}" for name in RULES]
    return judged.select(F.col("row.id").alias(id_col), *COUNTS[:5], "base_failed", "kept", "posterior", *COUNTS[5:], *votes)


def keep_good(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df that the rules keep, with all of their columns. Counts once, beside the rows, and shuffles no text.

    Null, empty and repeated rows are judged as by quality_rules; an empty table gives an empty result.
    """
    voted = cut(_voted(_counted(df, text_col, df.columns)))
    return _judged(voted, fit(voted), threshold).filter("kept").select("row.*")
