"""Allocation of cells to types of use under claims, and iterative proportional fitting."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ID, cut


JITTER = 1e-6
#: A sum that is off by less than this part of its total is met.
CLOSE = 1e-9


def _priced(suitability: DataFrame, prices: Mapping[str, float]) -> DataFrame:
    """Each cell's best and second best type at the prices: _id, use, best, margin, second; ties to the first type."""
    price = F.lit(0.0)
    for use, p in prices.items():
        price = F.when(F.col("use") == use, p).otherwise(price)
    bids = suitability.filter(F.col("suitability").isNotNull()).select(ID, F.struct((price - F.col("suitability")).alias("b"), "use").alias("o"))
    offers = bids.groupBy(ID).agg(F.sort_array(F.collect_list("o")).alias("o"))  # as many as there are types
    return offers.select(ID, F.col("o")[0]["use"].alias("use"), (-F.col("o")[0]["b"]).alias("bid"), F.get("o", F.lit(1))["use"].alias("second"), (F.get("o", F.lit(1))["b"] - F.col("o")[0]["b"]).alias("margin"))


def discrete_alloc(suitability: DataFrame, most: Mapping[str, int], least: Mapping[str, int] | None = None, rounds: int = 100, step: float = 1e-12) -> tuple[DataFrame, dict[str, float]]:
    """Cells to types so that no type has more than its claim, or less than its least one: (_id, use), and the shadow prices.

    suitability: _id, use, suitability, a row for each cell and type. A price auction: while a type
    is overclaimed, its price rises just above the margin at which enough of its cells prefer their
    second type; while one is underclaimed, its price falls just below that at which enough other
    cells prefer it. Prices are a number a type; cells stay distributed. Each cell's choice is the best at the final
    prices; without least claims the total is so as good as any, up to JITTER a cell. With them the
    claims hold, and a price that a later one made needless is not taken back. Claims that can't be
    met raise an error.
    """
    prices, floor = dict.fromkeys(most, 0.0), dict(least or {})
    # Ties are broken by a hash of the cell, far below any difference that matters.
    jitter = F.pmod(F.xxhash64(ID, "use"), F.lit(1 << 20)) * (JITTER / (1 << 20))
    suitability = cut(suitability.withColumn("suitability", F.col("suitability") + jitter))
    for _ in range(rounds):
        chosen = cut(_priced(suitability, prices))
        counts = {r[0]: r[1] for r in chosen.groupBy("use").count().collect()}
        over = {u: counts.get(u, 0) - m for u, m in most.items() if counts.get(u, 0) > m}
        under = {u: m - counts.get(u, 0) for u, m in floor.items() if counts.get(u, 0) < m}
        if not over and not under:
            return chosen.select(ID, "use"), prices
        if over:
            use = max(sorted(over), key=lambda u: over[u])
            margins, among, wanted, way = chosen.filter((F.col("use") == use) & F.col("margin").isNotNull()), counts[use], over[use], 1
        else:
            use = max(sorted(under), key=lambda u: under[u])
            own = suitability.filter((F.col("use") == use) & F.col("suitability").isNotNull()).select(ID, (F.col("suitability") - prices[use]).alias("_own"))
            margins = chosen.filter(F.col("use") != use).join(own, ID).select((F.col("bid") - F.col("_own")).alias("margin"))
            among, wanted, way = margins.count(), under[use], -1
            if among < wanted:
                break
        share = min(1.0, wanted / max(1, among))
        by = margins.agg(F.expr(f"percentile_disc({share!r}) WITHIN GROUP (ORDER BY margin)")).first()[0]
        if by is None:
            break
        prices[use] += way * (by + step)
    raise RuntimeError("the claims can't be met, or not in so many rounds")


def allocation_report(suitability: DataFrame, chosen: DataFrame, prices: Mapping[str, float], most: Mapping[str, int], least: Mapping[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Of each type total_allocated, shadow_price and status (met, at its most, at its least); of each cell (_id, use) its suitability and bid_price, what it pays above the price."""
    spark, floor = chosen.sparkSession, dict(least or {})
    claims = spark.createDataFrame([(u, int(m), int(floor.get(u, 0)), float(prices[u])) for u, m in most.items()], "use string, most bigint, least bigint, shadow_price double")
    counts = chosen.groupBy("use").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("total_allocated") == F.col("most"), "at its most").when((F.col("least") > 0) & (F.col("total_allocated") == F.col("least")), "at its least").otherwise("met")
    types = claims.join(counts, "use", "left").withColumn("total_allocated", F.coalesce("n", F.lit(0))).select("use", "total_allocated", "shadow_price", status.alias("status"))
    cells = chosen.join(suitability, [ID, "use"]).join(F.broadcast(claims), "use").select(ID, "use", "suitability", (F.col("suitability") - F.col("shadow_price")).alias("bid_price"))
    return types, cells


def greedy_alloc(suitability: DataFrame, most: Mapping[str, int]) -> DataFrame:
    """(_id, use): type by type in the order given, the most suitable cells that are left."""
    left, done = cut(suitability), None
    for use, n in most.items():
        best = left.filter((F.col("use") == use) & F.col("suitability").isNotNull()).orderBy(F.desc("suitability"), ID).limit(n).select(ID, F.lit(use).alias("use"))
        done = cut(best if done is None else done.unionAll(best))
        left = left.join(done.select(ID), ID, "left_anti")
    return done


def ipf_alloc(cells: DataFrame, row_totals: DataFrame, col_totals: DataFrame, rounds: int = 20) -> DataFrame:
    """(row, col, value): a table scaled by turns so that its rows and columns sum to the totals (row, total), (col, total).

    It ends when no row's sum is off by more than CLOSE of its total, or after the rounds, with a warning of how far off they are.
    """
    out, off = cells, 0.0
    for _ in range(rounds):
        for axis, totals in (("row", row_totals), ("col", col_totals)):
            factors = out.groupBy(axis).agg(F.sum("value").alias("_s")).join(totals, axis).select(axis, F.coalesce(F.try_divide("total", "_s"), F.lit(0.0)).alias("_f"))
            out = cut(out.join(factors, axis).select("row", "col", (F.col("value") * F.col("_f")).alias("value")))
        sums = out.groupBy("row").agg(F.sum("value").alias("_s")).join(row_totals, "row")
        off = sums.agg(F.max(F.abs(F.col("_s") - F.col("total")) / F.greatest(F.abs("total"), F.lit(1e-300)))).first()[0] or 0.0
        if off <= CLOSE:
            return out
    if rounds:
        warnings.warn(f"after {rounds} rounds a row's sum is off by {off:.3g} of its total", stacklevel=2)
    return out
