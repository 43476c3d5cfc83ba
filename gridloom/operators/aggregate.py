"""Aggregation over a whole domain, or along a relation with a result for every row of its target.

Undefined values are skipped, and rows with an undefined relation belong to no group. An empty
group sums to zero, counts zero, has any false and all true; other results are undefined.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import ID, cut, dense

#: name: aggregate of a column, and what an empty group has.
SIMPLE: dict[str, tuple[Callable[[Column], Column], object]] = {
    "sum": (F.sum, 0), "count": (F.count, 0), "mean": (F.avg, None), "var": (F.var_pop, None), "sd": (F.stddev_pop, None), "min": (F.min, None), "max": (F.max, None),
    "any": (F.bool_or, False), "all": (F.bool_and, True), "unique_count": (F.count_distinct, 0),
    "first": (lambda x: F.min_by(x, F.when(x.isNotNull(), F.col(ID))), None), "last": (lambda x: F.max_by(x, F.when(x.isNotNull(), F.col(ID))), None),
    "min_index": (lambda x: F.min_by(F.when(x.isNotNull(), F.col(ID)), F.when(x.isNotNull(), F.struct(x.alias("x"), F.col(ID).alias("i")))), None),
    "max_index": (lambda x: F.max_by(F.when(x.isNotNull(), F.col(ID)), F.when(x.isNotNull(), F.struct(x.alias("x"), (-F.col(ID)).alias("i")))), None),
}


def total(df: DataFrame, **aggregates: tuple[str, Column]) -> DataFrame:
    """One row: name=(aggregate, column)."""
    out = [(F.coalesce(SIMPLE[kind][0](x), F.lit(SIMPLE[kind][1])) if SIMPLE[kind][1] is not None else SIMPLE[kind][0](x)).alias(name) for name, (kind, x) in aggregates.items()]
    return df.agg(*out)


def along(df: DataFrame, rel: str, target: DataFrame, **aggregates: tuple[str, Column]) -> DataFrame:
    """On every row of the target: name=(aggregate, column) over the rows that refer to it."""
    grouped = df.filter(F.col(rel).isNotNull()).groupBy(rel).agg(*[SIMPLE[kind][0](x).alias(name) for name, (kind, x) in aggregates.items()])
    out = dense(target, grouped, rel)
    return out.select(ID, *[(F.coalesce(F.col(n), F.lit(SIMPLE[k][1])) if SIMPLE[k][1] is not None else F.col(n)).alias(n) for n, (k, _) in aggregates.items()])


def pcount(df: DataFrame, rel: str, target: DataFrame) -> DataFrame:
    grouped = df.filter(F.col(rel).isNotNull()).groupBy(rel).agg(F.count(F.lit(1)).alias("n"))
    return dense(target, grouped, rel).select(ID, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("has_any"))


def covariance(df: DataFrame, x: str, y: str, rel: str | None = None) -> DataFrame:
    """Population covariance and correlation of the rows that have both."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    grouped = both.groupBy(rel) if rel else both.groupBy()
    return grouped.agg(F.covar_pop(x, y).alias("cov"), F.corr(x, y).alias("corr"))


def _counted(df: DataFrame, x: str, rel: str | None, weight: str | None = None) -> tuple[DataFrame, list[str]]:
    keys = [rel] if rel else []
    rows = df.filter(F.col(x).isNotNull())
    rows = rows.filter(F.col(rel).isNotNull()) if rel else rows
    return rows.groupBy(*keys, x).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c")), keys


def modus(df: DataFrame, x: str, rel: str | None = None, weight: str | None = None) -> DataFrame:
    """The most frequent value, or that of the greatest weight, the least of equals; and how often it is there."""
    counts, keys = _counted(df, x, rel, weight)
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col(x).alias("v"))).alias("m"))
    return best.select(*keys, F.col("m.v").alias("modus"), (-F.col("m.c")).alias("modus_count"))


def entropy(df: DataFrame, x: str, rel: str | None = None) -> DataFrame:
    """Bits of information in the values, in all and by value."""
    counts, keys = _counted(df, x, rel)
    c = F.col("_c").cast("double")
    out = counts.groupBy(*keys).agg(F.sum(c).alias("n"), F.sum(c * F.ln(c)).alias("s"))
    bits = (F.col("n") * F.ln("n") - F.col("s")) / math.log(2)
    return out.select(*keys, bits.alias("entropy"), (bits / F.col("n")).alias("average_entropy"))


def frequency_table(df: DataFrame, x: str, rel: str | None = None) -> DataFrame:
    """value:count of the distinct values in order; and the values alone. One entry a distinct value of a group."""
    counts, keys = _counted(df, x, rel)
    out = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("v"), F.col("_c").alias("c")))).alias("t"))
    table = F.array_join(F.transform("t", lambda e: F.concat_ws(":", e["v"].cast("string"), e["c"].cast("string"))), ";")
    return out.select(*keys, table.alias("frequency_table"), F.array_join(F.transform("t", lambda e: e["v"].cast("string")), ";").alias("as_unique_list"))


def as_list(df: DataFrame, x: str, separator: str, rel: str | None = None) -> DataFrame:
    """The defined values in order, joined. A group's text is one value, as large as what it joins."""
    rows = df.filter(F.col(x).isNotNull())
    keys = [rel] if rel else []
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(ID, F.col(x).cast("string").alias("v")))).alias("t"))
    return out.select(*keys, F.array_join(F.transform("t", lambda e: e["v"]), separator).alias("as_list"))


def rth_element(df: DataFrame, x: str, r: float, rel: str | None = None) -> DataFrame:
    """The value at the fraction r of the order, linear between neighbours."""
    grouped = df.filter(F.col(rel).isNotNull()).groupBy(rel) if rel else df.groupBy()
    return grouped.agg(F.percentile(x, r).alias("rth_element"))


def nth_element(df: DataFrame, x: str, n: int, rel: str | None = None) -> DataFrame:
    """The n-th least defined value, from zero; by counts of distinct values, so that repeats cost nothing."""
    counts, keys = _counted(df, x, rel)
    w = Window.partitionBy(*keys).orderBy(x) if keys else Window.orderBy(x)
    upto = counts.withColumn("_to", F.sum("_c").over(w))
    return upto.filter(F.col("_to") > n).groupBy(*keys).agg(F.min(x).alias("nth_element"))


def nth_element_weighted(df: DataFrame, x: str, weight: str, target: float, rel: str | None = None) -> DataFrame:
    """The least value at which the weights of the values up to it exceed the target; weights of zero or less don't count."""
    counts, keys = _counted(df.filter(F.col(weight) > 0), x, rel, weight)
    w = Window.partitionBy(*keys).orderBy(x) if keys else Window.orderBy(x)
    return counts.withColumn("_to", F.sum("_c").over(w)).filter(F.col("_to") > target).groupBy(*keys).agg(F.min(x).alias("nth_element_weighted"))


def cumulate(df: DataFrame, x: str, rel: str | None = None, name: str = "cumulated") -> DataFrame:
    """Running sums in the domain's order; undefined values carry the sum before them.

    Along a relation by its groups. Over all rows in two passes: a range partition's running sum
    begins at the sum of the partitions before it.
    """
    if rel:
        return df.withColumn(name, F.sum(F.coalesce(F.col(x), F.lit(0))).over(Window.partitionBy(rel).orderBy(ID).rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut(df.repartitionByRange(ID).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(F.coalesce(F.sum(x), F.lit(0)).alias("s")).orderBy("_p").collect()  # one row a partition
    before = itertools.accumulate([0, *(r["s"] for r in sums)])
    kind = parts.agg(F.sum(x)).schema[0].dataType.simpleString()
    starts = df.sparkSession.createDataFrame([(r["_p"], type(r["s"])(b)) for r, b in zip(sums, before, strict=False)], f"_p int, _start {kind}")
    w = Window.partitionBy("_p").orderBy(ID).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.coalesce(F.col(x), F.lit(0))).over(w) + F.col("_start")
    return parts.join(F.broadcast(starts), "_p").withColumn(name, running).drop("_p", "_start")


def reg_count(df: DataFrame, kind: str, rel: str, kinds: list) -> DataFrame:
    """Rows by relation, a column for each kind."""
    return df.groupBy(rel).agg(*[F.count(F.when(F.col(kind) == k, 1)).alias(f"n_{k}") for k in kinds])


def statistics(df: DataFrame, x: str) -> DataFrame:
    """What the statistics view shows of a numeric attribute: variance of the population, deviation of the sample."""
    return df.agg(F.count(x).alias("n"), F.count(F.when(F.col(x).isNull(), 1)).alias("n_null"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum(x).alias("total"), F.avg(x).alias("average"), F.var_pop(x).alias("variance"), F.stddev_samp(x).alias("deviation"))
