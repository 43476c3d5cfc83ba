"""Secrets in texts: three fixed patterns, and strings whose characters look random.

Everything happens inside the row: no shuffle, no Python. Spark has no function for the places of
all matches, but a pattern's matches and the pieces between them (split with the same pattern)
alternate, so running sums of their lengths are the places.

The method: candidate strings are cut from the text; a window slides over each, and its Shannon
entropy follows from the counts of its characters, which change by one entering and one leaving
character at each step. Hexadecimal and mixed strings have alphabets, thresholds and windows of
their own. An allow-list suppresses strings that only look random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The contract's kinds, in its order, with the least length of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: class: what the whole candidate must match, and bits a character from which a window is random.
CLASSES = (("hexadecimal", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0), ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*$", 3.7))
#: Suppressed: what is known not to be a secret, or is digits or words joined by signs.
ALLOWED = (r"(?i)example|sample|placeholder|changeme|x{6}|0{6}|1234567|abcdefg", r"^[0-9+/_=-]+$", r"^[A-Za-z+/_=-]+$")


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _places(text: Column, pattern: str, likely: Column, value_group: int | None = None) -> Column:
    """Array of struct(from, to, value) of all matches, in code points; empty where not likely."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    values = _matches(text, pattern, 0 if value_group is None else value_group)
    pieces = F.arrays_zip(_matches(text, pattern).alias("m"), values.alias("v"), gaps.alias("g"))
    none = F.array().cast("array<struct<from:int,to:int,value:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["g"]
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("from"), end.alias("to"), x["v"].alias("value")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["m"].isNull(), state["found"]).otherwise(F.concat(state["found"], one)).alias("found"))

    return F.when(likely, F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]).otherwise(none)


def _hot(value: Column, threshold: Column) -> Column:
    """struct(first, last): from the first to the last window of at least threshold bits a character; nulls if there is none.

    Each place takes two half-steps: its character enters the window, then the one WINDOW back leaves.
    """
    weight = F.array(*[F.lit(0.0 if c == 0 else c * math.log2(c)) for c in range(WINDOW + 2)])
    code_at = lambda at: F.instr(F.lit(ALPHABET), F.substring(value, at + 1, F.lit(1)))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).cast("double").alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def half(state: Column, j: Column) -> Column:
        i = F.floor(j / 2).cast("int")
        enters = j % 2 == 0
        code = code_at(F.when(enters, i).otherwise(i - WINDOW))
        count = F.get(state["counts"], code)
        then = count + F.when(enters, 1).otherwise(-1)
        counts = F.concat(F.slice(state["counts"], F.lit(1), code), F.array(then), F.slice(state["counts"], code + 2, F.lit(len(ALPHABET) + 1)))
        s = state["s"] + F.get(weight, then) - F.get(weight, count)
        idle = ~enters & (i < WINDOW)
        # A window is whole once the character that left is out: on the second half-step.
        full = ~enters & (i >= WINDOW - 1)
        bits = math.log2(WINDOW) - F.when(idle, state["s"]).otherwise(s) / WINDOW
        hot = full & (bits >= threshold)
        return F.struct(
            F.when(idle, state["counts"]).otherwise(counts).alias("counts"), F.when(idle, state["s"]).otherwise(s).alias("s"),
            F.when(hot & state["first"].isNull(), i - WINDOW + 1).otherwise(state["first"]).alias("first"), F.when(hot, i + 1).otherwise(state["last"]).alias("last"),
        )

    out = F.aggregate(F.sequence(F.lit(0), 2 * F.length(value) - 1), start, half)
    return F.struct(out["first"].alias("first"), out["last"].alias("last"))


def _threshold(value: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    limit = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        limit = F.when(value.rlike(pattern), bits).otherwise(limit)
    return F.when(~allowed, limit)


def _spans(kind: str, places: Column) -> Column:
    return F.transform(places, lambda x: F.struct(x["from"].alias("from"), F.lit(KINDS.index(kind)).alias("rank"), x["to"].alias("to"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["from"], x["to"])), ",")


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Spans of the
    method lie from the first to the last random window of a candidate; those inside a span of the
    base are left out, those of the base always stay. A null text counts as empty and has no spans.
    Repeated rows each give a row; an empty table gives an empty result; null ids are carried.
    Other columns of df are not read.
    """
    df = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    text = F.col("text")
    df = df.select(
        "id",
        _places(text, ASSIGN, text.rlike(ASSIGN), 2).alias("assign"),
        _places(text, ACCESS, text.contains("AKIA")).alias("access"),
        _places(text, HEX, text.rlike(HEX)).alias("hex"),
        F.filter(_places(text, CANDIDATE, text.rlike(CANDIDATE)), lambda x: x["value"].rlike("[0-9]")).alias("candidates"),
    )
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(x["value"]) >= MIN_VALUE))
    df = df.select("id", "assign", "access", "hex", F.transform("candidates", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"), _threshold(x["value"]).alias("limit"))).alias("candidates"))
    df = df.withColumn("candidates", F.filter("candidates", lambda x: x["limit"].isNotNull()))
    df = df.withColumn("base", F.concat(*[_spans(k, F.col(k)) for k in KINDS[:3]]))
    df = df.withColumn("hot", F.transform("candidates", lambda x: F.struct(x["from"].alias("from"), _hot(x["value"], x["limit"]).alias("hot"))))
    found = F.transform(F.filter("hot", lambda x: x["hot"]["first"].isNotNull()), lambda x: F.struct((x["from"] + x["hot"]["first"]).alias("from"), (x["from"] + x["hot"]["last"]).alias("to")))
    df = df.withColumn("found", F.filter(found, lambda x: ~F.exists("base", lambda b: (b["from"] <= x["from"]) & (b["to"] >= x["to"]))))
    return df.select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", _spans("entropy", F.col("found")))).alias("spans"),
        F.size("found").cast("long").alias("n_entropy"),
    )
