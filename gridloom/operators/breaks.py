"""Class breaks: the lower bounds of k classes of a numeric attribute.

All but the interval methods work on the distinct values with their counts, which Spark counts. The
natural breaks read all of them on the driver, some hundred bytes a distinct value.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ID, cut, discard, with_ordinal
from .aggregate import cumulate


def _frame(df: DataFrame, breaks: list[float]) -> DataFrame:
    rows = [(i, float(b) if b is not None else None) for i, b in enumerate(breaks)]
    return df.sparkSession.createDataFrame(rows, "_id bigint, bound double")


def _ends(df: DataFrame, x: str) -> tuple[float, float] | None:
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    return None if lo is None else (float(lo), float(hi))


def equal_interval(df: DataFrame, x: str, k: int) -> DataFrame:
    """From the least to the greatest value in equal steps."""
    ends = _ends(df, x)
    return _frame(df, [None] * k if ends is None else [ends[0] + j * (ends[1] - ends[0]) / max(k - 1, 1) for j in range(k)])


def nonzero_equal_interval(df: DataFrame, x: str, k: int) -> DataFrame:
    """A class for zero, then equal steps over the values that aren't."""
    ends = _ends(df.filter(F.col(x) != 0), x)
    rest = [] if ends is None else [ends[0] + j * (ends[1] - ends[0]) / max(k - 2, 1) for j in range(k - 1)]
    return _frame(df, sorted([0.0, *rest]) + [None] * (k - 1 - len(rest)))


def log_interval(df: DataFrame, x: str, k: int) -> DataFrame:
    """Steps equal in the logarithm, over the positive values."""
    ends = _ends(df.filter(F.col(x) > 0), x)
    return _frame(df, [None] * k if ends is None else [math.exp(math.log(ends[0]) + j * (math.log(ends[1]) - math.log(ends[0])) / max(k - 1, 1)) for j in range(k)])


def unique_values(df: DataFrame, x: str, k: int) -> DataFrame:
    """The k least distinct values; the last again where there are fewer."""
    values = [float(r[0]) for r in df.filter(F.col(x).isNotNull()).select(x).distinct().orderBy(x).limit(k).collect()]
    return _frame(df, values + values[-1:] * (k - len(values)) if values else [None] * k)


def equal_count(df: DataFrame, x: str, k: int, nonzero: bool = False) -> DataFrame:
    """Classes of about as many rows each: the rows that are left are dealt to the classes that are left, each with a distinct value of its own at least.

    The distinct values are numbered with the rows before each; a class takes one look at them.
    """
    rows = df.filter(F.col(x).isNotNull() & (F.col(x) != 0 if nonzero else F.lit(True)))
    counts = rows.groupBy(F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    known = cut(cumulate(with_ordinal(counts, ["v"]), "c", name="upto").select(ID, "v", (F.col("upto") - F.col("c")).alias("before")))
    n, m = rows.count(), known.count()
    classes = k - nonzero
    if not m:
        return _frame(df, [None] * k)
    found, most, want = [], min(classes, m), 0
    for j in range(most):
        # The first value with `want` rows before it, but no further than leaves a value for each class after this one.
        last = m + j - most
        row = known.filter((F.col("before") >= want) | (F.col(ID) == last)).agg(F.min(F.struct(ID, "v", "before")).alias("f")).first()["f"]
        found.append(row["v"])
        want = row["before"] + (n - row["before"]) // (most - j)
    discard(known)
    return _frame(df, ([0.0] if nonzero else []) + found + found[-1:] * (classes - most))


def natural_breaks(values: np.ndarray, weights: np.ndarray, k: int) -> list[float]:
    """Lower bounds of the k classes of sorted values with the least sum of squared deviations.

    The last class's beginning moves on with the number of values, so each class is filled in by
    divide and conquer over the places where it may begin.
    """
    n, k = len(values), min(k, len(values))
    # Sums run outward from the middle value, and of what values differ from it: a far value at an end is in no other's sums.
    middle = n // 2
    x, w = np.asarray(values, np.longdouble) - values[middle], np.asarray(weights, np.longdouble)

    def outward(a: np.ndarray) -> np.ndarray:
        return np.concatenate([-np.cumsum(a[:middle][::-1])[::-1], [0], np.cumsum(a[middle:])])

    w, wx, wxx = outward(w), outward(w * x), outward(w * x * x)

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.maximum(wxx[j] - wxx[i] - (wx[j] - wx[i]) ** 2 / (w[j] - w[i]), 0)

    best = np.concatenate([[np.inf], cost(np.zeros(n, np.int64), np.arange(1, n + 1))])
    begins = []
    for c in range(2, k + 1):
        now, begin = np.full(n + 1, np.inf, np.longdouble), np.zeros(n + 1, np.int64)
        # All halves of one depth at once: the ends lo..hi, and first..last where their classes may begin.
        lo, hi, first, last = (np.array([v]) for v in (c, n, c - 1, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(last, j - 1) - first + 1
            start = np.cumsum(size) - size
            i = np.arange(size.sum()) + np.repeat(first - start, size)
            total = best[i] + cost(i, np.repeat(j, size))
            now[j] = np.minimum.reduceat(total, start)
            least = np.flatnonzero(total == np.repeat(now[j], size))
            begin[j] = at = i[least[np.searchsorted(least, start)]]
            lo, hi, first, last = np.concatenate([lo, j + 1]), np.concatenate([j - 1, hi]), np.concatenate([first, at]), np.concatenate([at, last])
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        best = now
        begins.append(begin)
    out, j = [], n
    for begin in reversed(begins):
        j = int(begin[j])
        out.append(float(values[j]))
    return [float(values[0]), *reversed(out)]


def jenks_fisher(df: DataFrame, x: str, k: int, nonzero: bool = False) -> DataFrame:
    rows = df.filter(F.col(x).isNotNull() & (F.col(x) != 0 if nonzero else F.lit(True)))
    found = rows.groupBy(F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("v")
    if not len(found):
        return _frame(df, [None] * k)
    breaks = natural_breaks(found["v"].to_numpy(), found["n"].to_numpy(float), k - nonzero)
    breaks = ([0.0] if nonzero else []) + breaks
    return _frame(df, breaks + breaks[-1:] * (k - len(breaks)))
