"""Operators that are compositions of others: rescaling, order, nearness, logits and claims.

Totals over all rows, or over the rows of a group, join back as one row or as one row a group; no
window takes all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import ID, dense, with_ordinal
from .elementwise import div, eq, is_overlapping, is_positive, is_zero, log, max_elem, min_elem


def _with_totals(df: DataFrame, rel: str | None, **totals: Column) -> DataFrame:
    """df with each total beside every row: of its group, or of all rows."""
    aggregates = [c.alias(name) for name, c in totals.items()]
    if rel is None:
        return df.crossJoin(F.broadcast(df.agg(*aggregates)))  # one row
    sums = df.filter(F.col(rel).isNotNull()).groupBy(F.col(rel).alias("_rel")).agg(*aggregates)
    return df.join(sums, df[rel] == F.col("_rel"), "left").drop("_rel")


def scalesum(df: DataFrame, x: str, total: float | None = None, rel: str | None = None, target: DataFrame | None = None, amount: str | None = None, name: str = "scalesum") -> DataFrame:
    """x scaled so that its sum is the total, or, along a relation, each group's sum the target's amount; a total of zero gives zeros."""
    out = _with_totals(df, rel, _sum=F.sum(x))
    if rel is None:
        want = F.lit(float(total))
    else:
        out = out.join(target.select(F.col(ID).alias("_to"), F.col(amount).alias("_amount")), F.col(rel) == F.col("_to"), "left").drop("_to")
        want = F.col("_amount")
    out = out.withColumn(name, F.when(is_zero(want), want).otherwise(F.col(x) * div(want, F.col("_sum"))))
    return out.drop("_sum", "_amount")


def distribute(df: DataFrame, total: float, x: str, name: str = "distribute") -> DataFrame:
    """A total dealt out in proportion to x."""
    return scalesum(df, x, total, name=name)


def distribute_along(df: DataFrame, target: DataFrame, amount: str, x: str, rel: str, name: str = "distribute") -> DataFrame:
    return scalesum(df, x, rel=rel, target=target, amount=amount, name=name)


def rescale(df: DataFrame, x: str, lo: float = 0.0, hi: float = 1.0, rel: str | None = None, name: str = "rescale") -> DataFrame:
    """x moved linearly so that its least value, of its group, is lo and its greatest hi."""
    out = _with_totals(df, rel, _lo=F.min(x), _hi=F.max(x))
    scaled = (F.col(x) - F.col("_lo")) * div(F.lit(float(hi - lo)), (F.col("_hi") - F.col("_lo")).cast("double")) + F.lit(float(lo))
    return out.withColumn(name, scaled).drop("_lo", "_hi")


def normalize(df: DataFrame, x: str, mean: float = 0.0, sd: float = 1.0, name: str = "normalize") -> DataFrame:
    """x moved linearly to a mean and a standard deviation, of the population."""
    out = _with_totals(df, None, _mean=F.avg(x), _sd=F.stddev_pop(x))
    return out.withColumn(name, (F.col(x) - F.col("_mean")) * div(F.lit(float(sd)), F.col("_sd")) + F.lit(float(mean))).drop("_mean", "_sd")


def reversed_id(df: DataFrame, name: str = "reversed_id") -> DataFrame:
    """Of each row the ordinal of the row as far from the end as it is from the beginning."""
    out = _with_totals(df, None, _n=F.count(F.lit(1)))
    return out.withColumn(name, F.col("_n") - 1 - F.col(ID)).drop("_n")


def reverse(df: DataFrame, x: str, name: str = "reverse") -> DataFrame:
    """The values in reversed order."""
    back = reversed_id(df.select(ID, F.col(x).alias(name)))
    return df.join(back.select(F.col("reversed_id").alias(ID), name), ID)


def sort_str(df: DataFrame, x: str) -> DataFrame:
    """The texts in order, undefined ones first."""
    return with_ordinal(df.select(x), [x])


def direct_index(df: DataFrame, x: str) -> DataFrame:
    """(_id, direct_index): the ordinals of the rows in order of x, equal ones as they came."""
    return with_ordinal(df.select(F.col(x).alias("_x"), F.col(ID).alias("direct_index")), ["_x", "direct_index"]).drop("_x")


def subindex(df: DataFrame, *keys: str) -> DataFrame:
    """(_id, subindex): an order by the first key, refined by each next one where those before are equal."""
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ID).alias("subindex"))
    return with_ordinal(rows, [*[f"_k{i}" for i in range(len(keys))], "subindex"]).select(ID, "subindex")


def union_unit(*domains: DataFrame) -> DataFrame:
    """A domain as long as all domains together: part, the place of the one a row is of, and its ordinal there."""
    rows = [d.select(F.lit(i).alias("part"), F.col(ID).alias("part_rel")) for i, d in enumerate(domains)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return with_ordinal(out, ["part", "part_rel"])


def order(a: Column, b: Column) -> Column:
    """The interval from the lesser to the greater."""
    return F.struct(min_elem(a, b).alias("lo"), max_elem(a, b).alias("hi"))


def float_is_nearby(a: Column, b: Column, factor: float) -> Column:
    """Whether the intervals from each value to `factor` times it overlap."""
    one, two = order(a, a * factor), order(b, b * factor)
    return is_overlapping(one["lo"], one["hi"], two["lo"], two["hi"])


def point_is_nearby(a: Column, b: Column, factor: float) -> Column:
    return float_is_nearby(a["x"], b["x"], factor) & float_is_nearby(a["y"], b["y"], factor)


def llpart(expected: Column, size: Column, observed: Column) -> Column:
    return observed * log(size) - log(expected)


def log_likelihood(expected: Column, size: Column, observed: Column) -> Column:
    """llpart of what was observed and of the rest."""
    return llpart(expected, size, observed) + llpart(expected, size - expected, size - observed)


def claim_div(claim: Column, made: Column) -> Column:
    return F.when(is_positive(claim), div(claim, made)).otherwise(F.lit(0.0))


def claim_corr(claim: Column, made: Column, kind: Column) -> Column:
    """The factor to a claim: at most one for kind 0, as it is for 1, at least one for 2, one for others."""
    factor = claim_div(claim, made)
    return F.when(eq(kind, F.lit(0)), F.least(factor, F.lit(1.0))).when(eq(kind, F.lit(1)), factor).when(eq(kind, F.lit(2)), F.greatest(factor, F.lit(1.0))).otherwise(F.lit(1.0))


def mapping_count(grid: DataFrame, target: DataFrame) -> DataFrame:
    """On each cell of the target (row, col) how many cells of the grid map to it (to_row, to_col)."""
    counts = grid.groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.count(F.lit(1)).alias("mapping_count"))
    return target.join(counts, ["row", "col"], "left").fillna({"mapping_count": 0})


def ramp_rgb(first: int, last: int, n: int, ordinal: Column, open_: bool = False) -> Column:
    """A ramp of each of the three colours of a number."""
    size = n if open_ else max(n - 1, 1)

    def channel(shift: int) -> Column:
        a, b = (first >> shift) & 255, (last >> shift) & 255
        return F.shiftleft(F.floor((F.lit(float(a)) * (size - ordinal) + F.lit(float(b)) * ordinal) / size).cast("int"), shift)

    return channel(0) + channel(8) + channel(16)


def frequency_table_with_null(df: DataFrame, x: str, rel: str | None = None, separator: str = ";") -> DataFrame:
    """value:count of each value in order, undefined ones first as `null`."""
    keys = [rel] if rel else []
    rows = df.filter(F.col(rel).isNotNull()) if rel else df
    counts = rows.groupBy(*keys, F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    out = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("t"))
    pair = lambda e: F.concat(F.coalesce(e["v"].cast("string"), F.lit("null")), F.lit(":"), e["c"].cast("string"))
    return out.select(*keys, F.array_join(F.transform("t", pair), separator).alias("frequency_table"))


def as_item_list(df: DataFrame, x: str, rel: str | None = None, separator: str = ",", with_null: bool = False, quoted: bool = False) -> DataFrame:
    """The texts of a group in the domain's order; quoted for expressions, undefined ones left out or as `null`. A group's list is as long as the group."""
    text = F.col(x).cast("string")
    text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")) if quoted else text
    text = F.coalesce(text, F.lit("null")) if with_null else text
    keys = [rel] if rel else []
    rows = df.select(*keys, F.struct(F.col(ID).alias("o"), text.alias("v")).alias("e")).filter("e.v IS NOT NULL")
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("t"))
    return out.select(*keys, F.array_join(F.transform("t", lambda e: e["v"]), separator).alias("as_list"))


def collect_attr_by_cond(domain: DataFrame, cond: Column) -> DataFrame:
    """All attributes of the rows that meet a condition, as a domain of their own; org_rel is the row they were."""
    return with_ordinal(domain.filter(F.coalesce(cond, F.lit(False))).withColumnRenamed(ID, "org_rel"), ["org_rel"])


def collect_attr_by_org_rel(subset: DataFrame, domain: DataFrame, rel: str = "org_rel") -> DataFrame:
    """The attributes of the domain on the rows of a subset that refer to it; undefined where that is nothing."""
    there = domain.withColumnRenamed(ID, "_to")
    return subset.join(there, subset[rel] == F.col("_to"), "left").drop("_to")


def subset(domain: DataFrame, cond: Column) -> DataFrame:
    """(_id, nr_OrgEntity) of the rows that meet a condition."""
    return collect_attr_by_cond(domain.select(ID, cond.alias("_cond")), F.col("_cond")).select(ID, F.col("org_rel").alias("nr_OrgEntity"))


def typed_sum(df: DataFrame, x: str, kind: str, rel: str, domain: DataFrame) -> DataFrame:
    """sum_<kind>: sums of whole numbers, with an error where one doesn't fit the type. Empty groups sum to zero."""
    from .elementwise import RANGES, STORED

    lo, hi = RANGES[kind]
    sums = df.filter(F.col(rel).isNotNull()).groupBy(rel).agg(F.coalesce(F.sum(F.col(x).cast("decimal(38,0)")), F.lit(0)).alias("s"))
    out = dense(domain, sums, rel, {"s": 0})
    fits = F.assert_true(F.col("s").between(lo, hi), F.concat(F.lit(f"a sum doesn't fit {kind}: "), F.col("s").cast("string")))
    return out.select(ID, F.when(fits.isNull(), F.col("s")).cast(STORED[kind]).alias(f"sum_{kind}"))
