"""Rasters: cells with integer row and col. A neighbour is a shifted equi-join; kernels are small and go as literals."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import ID, cut
from .lookup import parallelism

#: Cells along each side of a tile.
TILE = 256
SIDES = ((-1, 0), (0, 1), (0, -1), (1, 0))
CORNERS = ((-1, -1), (-1, 1), (1, -1), (1, 1))
WEIGHTS = ((SIDES, 0.5), (CORNERS, 0.5 * math.sqrt(2)))
#: A tile of least costs has at most the square of this many cells; so many tiles are named when they are read.
REACH, AT_ONCE = 512, 1000


def _shifts(cells: Sequence[tuple]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(c[0]).alias("dr"), F.lit(c[1]).alias("dc"), F.lit(float(c[2]) if len(c) > 2 else 1.0).alias("w")) for c in cells]))


def potential(grid: DataFrame, value: str, kernel: dict[tuple[int, int], float], name: str = "potential") -> DataFrame:
    """At each cell the sum of value(cell + d) * kernel(d); undefined values count as zero."""
    spread = grid.filter(F.col(value).isNotNull()).withColumn("_k", _shifts([(-r, -c, w) for (r, c), w in kernel.items()]))
    spread = spread.select((F.col("row") + F.col("_k.dr")).alias("row"), (F.col("col") + F.col("_k.dc")).alias("col"), (F.col(value) * F.col("_k.w")).alias("_v"))
    sums = spread.groupBy("row", "col").agg(F.sum("_v").alias(name))
    return grid.join(sums, ["row", "col"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def proximity(grid: DataFrame, value: str, kernel: dict[tuple[int, int], float], name: str = "proximity") -> DataFrame:
    """As potential, with the greatest product in place of the sum, and zero at least."""
    spread = grid.filter(F.col(value).isNotNull()).withColumn("_k", _shifts([(-r, -c, w) for (r, c), w in kernel.items()]))
    spread = spread.select((F.col("row") + F.col("_k.dr")).alias("row"), (F.col("col") + F.col("_k.dc")).alias("col"), (F.col(value) * F.col("_k.w")).alias("_v"))
    best = spread.groupBy("row", "col").agg(F.max("_v").alias(name))
    return grid.join(best, ["row", "col"], "left").withColumn(name, F.greatest(F.coalesce(name, F.lit(0.0)), F.lit(0.0)))


def perimeter(grid: DataFrame, region: str, north: float = 1.0, east: float = 1.0, west: float = 1.0, south: float = 1.0) -> DataFrame:
    """Of each region the weighted cell sides that face another value or the grid's edge."""
    weights = zip(SIDES, (north, east, west, south), strict=True)
    faces = grid.filter(F.col(region).isNotNull()).withColumn("_k", _shifts([(r, c, w) for (r, c), w in weights]))
    faces = faces.select(region, (F.col("row") + F.col("_k.dr")).alias("row"), (F.col("col") + F.col("_k.dc")).alias("col"), F.col("_k.w").alias("w"))
    other = grid.select("row", "col", F.col(region).alias("_other"))
    open_ = faces.join(other, ["row", "col"], "left").select(region, F.when(F.col(region) == F.col("_other"), 0.0).otherwise(F.col("w")).alias("w"))
    return open_.groupBy(region).agg(F.sum("w").alias("perimeter"))


def diversity(grid: DataFrame, value: str, radius: int, circle: bool = True) -> DataFrame:
    """At each cell the number of distinct values within a radius."""
    near = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if not circle or r * r + c * c <= radius * radius]
    # Dealt out by blocks of cells first, then by cell: neither a large file's one task nor few ones hold what is spread.
    cells = grid.select("row", "col", value).repartition(parallelism(grid), F.floor(F.col("row") / TILE), F.floor(F.col("col") / TILE))
    spread = cells.withColumn("_k", _shifts(near)).select((F.col("row") + F.col("_k.dr")).alias("row"), (F.col("col") + F.col("_k.dc")).alias("col"), F.col(value).alias("_v"))
    counts = spread.repartition(parallelism(grid), "row", "col").distinct().groupBy("row", "col").agg(F.count("_v").alias("diversity"))
    return grid.join(counts.hint("merge"), ["row", "col"], "left")


def district(grid: DataFrame, value: str, corners: bool = False) -> DataFrame:
    """Connected zones of equal values, by four neighbours or eight, numbered by their first cell."""
    from .network import connected_parts

    cells = grid.filter(F.col(value).isNotNull())
    near = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if corners else [])]
    there = cells.select("row", "col", F.col(ID).alias("f2"), F.col(value).alias("_other"))
    edges = cells.withColumn("_k", _shifts(near)).select(F.col(ID).alias("f1"), F.col(value).alias("_own"), (F.col("row") + F.col("_k.dr")).alias("row"), (F.col("col") + F.col("_k.dc")).alias("col"))
    edges = edges.join(there, ["row", "col"]).filter(F.col("_own") == F.col("_other")).select("f1", "f2")
    return cells.select(ID, "row", "col", value).join(connected_parts(cells.select(ID), edges), ID).withColumnRenamed("part_rel", "district")


def _steps(wide: int) -> list[tuple[int, float]]:
    """Where the eight neighbours of a place lie in rows of so many cells, and what half the sum of both impedances is multiplied by."""
    return [(dr * wide + dc, weight) for shifts, weight in WEIGHTS for dr, dc in shifts]


def _solved(limit: float, rim: bool) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Least costs within a tile, from its start cells and what is known of its rim; of the rim alone those that are reached."""

    def run(key: tuple, cells: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        row0, col0 = cells["row"].min() - 1, cells["col"].min() - 1
        # Cells without impedance lie around the tile's.
        high, wide = int(cells["row"].max() - row0 + 2), int(cells["col"].max() - col0 + 2)
        place = lambda df: ((df["row"] - row0).astype("int64") * wide + (df["col"] - col0)).to_numpy()
        at, best, cost = place(cells), np.full(high * wide, math.inf), np.full(high * wide, math.nan)
        cost[at] = cells["imp"]
        best[at[cells["start"].to_numpy(bool)]] = 0.0
        np.minimum.at(best, place(known), known["dist"].to_numpy())
        heap = [(best[i], i) for i in np.flatnonzero(best < math.inf).tolist()]
        imp, dist, steps = cost.tolist(), best.tolist(), _steps(wide)
        heapq.heapify(heap)
        while heap:
            d, i = heapq.heappop(heap)
            if d > dist[i]:
                continue
            own = imp[i]
            for step, weight in steps:
                j = i + step
                if (new := d + (own + imp[j]) * weight) < dist[j] and new < limit:
                    dist[j] = new
                    heapq.heappush(heap, (new, j))
        found = np.array(dist)[at]
        if not rim:
            return cells[["row", "col"]].assign(dist=found)
        return cells[["tile", "row", "col"]].assign(dist=found)[cells["rim"].to_numpy(bool) & (found < math.inf)]

    return run


def _shape(rows: int, cols: int, tile: int) -> tuple[int, int]:
    """Rows and columns of a tile of at most tile * tile cells: a square, or as long as it may be where the grid is narrow."""
    wide = min(cols, tile)
    high = min(rows, tile * tile // wide)
    return high, min(cols, tile * tile // high)


def grid_distance(grid: DataFrame, impedance: str, start: str, limit: float = math.inf, tile: int = REACH) -> DataFrame:
    """Least cost from the start cells over eight neighbours: half the sum of both cells' impedance, by the root of two across corners.

    Only costs below the limit count. A tile has at most tile * tile cells, however narrow the grid is. Each round finds the least
    costs inside the tiles that a lower cost was offered to, and offers their rims' costs to their neighbours; what it reads and
    writes are those tiles and the rims. It ends when no offer is lower than what is known. Then all tiles are filled in at once.
    """
    cells = grid.filter(F.col(impedance).isNotNull()).select(F.col("row").cast("int"), F.col("col").cast("int"), F.greatest(F.col(impedance), F.lit(0.0)).cast("double").alias("imp"), F.coalesce(F.col(start), F.lit(False)).alias("start"))
    cells = cut(cells.filter("row IS NOT NULL AND col IS NOT NULL"))
    row0, row1, col0, col1 = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if row0 is None:
        return cells.select("row", "col", F.lit(None).cast("double").alias("dist"))
    high, wide = _shape(row1 - row0 + 1, col1 - col0 + 1, tile)
    down, across, parts = (row1 - row0) // high, (col1 - col0) // wide, parallelism(grid)
    r, c = (F.col(x).cast("long") - F.lit(x0).cast("long") for x, x0 in (("row", row0), ("col", col0)))
    inside = lambda x, size, last: ((x % size == 0) & (x > 0)) | ((x % size == size - 1) & (x < last * size))
    dealt = cells.withColumn("tile", F.floor(r / high) * (across + 1) + F.floor(c / wide)).withColumn("rim", inside(r, high, down) | inside(c, wide, across))
    # Sorted, so that a file's parts which hold no wanted tile are passed over.
    cells = cut(dealt.repartition(parts, "tile").sortWithinPartitions("tile"), cells)
    rim = cells.filter("rim").select("tile", "row", "col", "imp")
    there = rim.select(F.col("tile").alias("to"), "row", "col", F.col("imp").alias("other"))
    links = rim.withColumn("_k", _shifts([(*s, weight) for shifts, weight in WEIGHTS for s in shifts]))
    links = links.select("tile", F.col("row").alias("r"), F.col("col").alias("c"), "imp", (F.col("row") + F.col("_k.dr")).alias("row"), (F.col("col") + F.col("_k.dc")).alias("col"), "_k.w")
    links = cut(links.join(there, ["row", "col"]).filter("tile != to").select("r", "c", "to", "row", "col", ((F.col("imp") + F.col("other")) * F.col("w")).alias("cost")))

    def solved(cells: DataFrame, known: DataFrame, rim: bool) -> DataFrame:
        both = (x.repartition(parts, "tile").groupBy("tile") for x in (cells, known.select("tile", "row", "col", "dist")))
        return next(both).cogroup(next(both)).applyInPandas(_solved(limit, rim), "tile long, row int, col int, dist double" if rim else "row int, col int, dist double")

    known = cut(cells.select("tile", "row", "col", F.col("imp").alias("dist"), F.lit(True).alias("lower")).limit(0))
    changed = cells.filter("start")
    while tiles := [x[0] for x in changed.select("tile").distinct().limit(AT_ONCE + 1).collect()]:
        wanted = (lambda df: df.filter(F.col("tile").isin(tiles))) if len(tiles) <= AT_ONCE else (lambda df: df.join(changed.select("tile").distinct(), "tile", "left_semi"))  # noqa: B023
        found = cut(solved(wanted(cells), wanted(known), True))
        offers = found.withColumnsRenamed({"row": "r", "col": "c"}).drop("tile").join(links, ["r", "c"])
        offers = offers.select(F.col("to").alias("tile"), "row", "col", (F.col("dist") + F.col("cost")).alias("dist"), F.lit(None).cast("double").alias("own")).filter(F.col("dist") < limit)
        own = known.drop("lower").unionByName(found).withColumn("own", F.col("dist"))
        best = own.unionByName(offers).groupBy("tile", "row", "col").agg(F.min("dist").alias("dist"), F.min("own").alias("own"))
        known = cut(best.select("tile", "row", "col", "dist", (F.col("own").isNull() | (F.col("dist") < F.col("own"))).alias("lower")), known, found)
        changed = known.filter("lower")
    return solved(cells, known, False).select("row", "col", F.when(F.col("dist") < math.inf, F.col("dist")).alias("dist"))


def mapping(source: DataFrame, factor: float, row0: float = 0.0, col0: float = 0.0) -> DataFrame:
    """Each cell's cell in a grid of another size: floor((place + offset) * factor)."""
    at = lambda c, o: F.floor((F.col(c) + F.lit(o)) * factor).cast("int")
    return source.select(ID, at("row", row0).alias("to_row"), at("col", col0).alias("to_col"))


def raster_merge(grid: DataFrame, choice: str, *values: str) -> DataFrame:
    """At each cell the value that its choice points at."""
    return grid.select(ID, F.get(F.array(*values), F.col(choice)).alias("merged"))
