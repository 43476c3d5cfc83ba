"""Points, sequences of points and polygons: struct<x, y> and arrays of it, measured inside the row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import ID, with_ordinal


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def sqrdist(a: Column, b: Column) -> Column:
    return (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(sqrdist(a, b))


def _pairs(seq: Column) -> Column:
    """Each vertex but the last with the next."""
    return F.transform(F.slice(seq, F.lit(1), F.greatest(F.size(seq) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("p"), F.get(seq, i + 1).alias("q")))


def lower_bound(seq: Column) -> Column:
    return point(F.array_min(F.transform(seq, lambda p: p["x"])), F.array_min(F.transform(seq, lambda p: p["y"])))


def upper_bound(seq: Column) -> Column:
    return point(F.array_max(F.transform(seq, lambda p: p["x"])), F.array_max(F.transform(seq, lambda p: p["y"])))


def center_bound(seq: Column) -> Column:
    lo, hi = lower_bound(seq), upper_bound(seq)
    return point((lo["x"] + hi["x"]) / 2, (lo["y"] + hi["y"]) / 2)


def first_point(seq: Column) -> Column:
    return F.get(seq, F.lit(0))


def last_point(seq: Column) -> Column:
    return F.get(seq, F.size(seq) - 1)


def _sum(seq: Column, f) -> Column:
    return F.aggregate(_pairs(seq), F.lit(0.0), lambda s, e: s + f(e["p"], e["q"]))


def arc_length(seq: Column) -> Column:
    return _sum(seq, lambda p, q: dist(p, q))


def _closed(seq: Column) -> Column:
    return F.concat(seq, F.slice(seq, F.lit(1), F.lit(1)))


def signed_area(ring: Column) -> Column:
    return _sum(_closed(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Of the ring's surface; undefined if that is nothing."""
    closed, a = _closed(ring), signed_area(ring)
    moment = lambda axis: _sum(closed, lambda p, q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])) / (6 * a)
    return F.when(a != 0, point(moment("x"), moment("y")))


def mls_length(seq: Column) -> Column:
    """The length of lines in one sequence, with undefined points between them."""
    return _sum(seq, lambda p, q: F.coalesce(dist(p, q), F.lit(0.0)))


def mid(ring: Column) -> Column:
    """A place within a ring: the middle of the widest stretch inside of it on the line across the middle of its box."""
    lo, hi = lower_bound(ring), upper_bound(ring)
    y = (lo["y"] + hi["y"]) / 2
    met = F.filter(_pairs(_closed(ring)), lambda e: (e["p"]["y"] > y) != (e["q"]["y"] > y))
    at = F.array_sort(F.transform(met, lambda e: (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))
    spans = F.transform(F.filter(F.transform(at, lambda x, i: F.struct((F.get(at, i + 1) - x).alias("w"), ((F.get(at, i + 1) + x) / 2).alias("x"), (i % 2).alias("odd"))), lambda s: s["odd"] == 0), lambda s: F.struct(s["w"], s["x"]))
    return F.when(F.size(ring) > 2, point(F.array_max(spans)["x"], y))


def centroid_or_mid(ring: Column) -> Column:
    """The centroid if it lies within, else a place that does."""
    middle = centroid(ring)
    return F.when(F.coalesce(inside(middle, ring), F.lit(False)), middle).otherwise(mid(ring))


def points2sequence(points: DataFrame, geometry: str, rel: str, ordinal: str = ID) -> DataFrame:
    """The points of each sequence in order of the ordinal."""
    grouped = points.filter(F.col(rel).isNotNull()).groupBy(F.col(rel).alias(ID)).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(geometry).alias("p")))).alias("_s"))
    return grouped.select(ID, F.transform("_s", lambda e: e["p"]).alias("geometry"))


def sequence2points(seqs: DataFrame, geometry: str) -> DataFrame:
    points = seqs.select(F.col(ID).alias("sequence_rel"), F.posexplode(geometry).alias("ordinal", "point"))
    return with_ordinal(points, ["sequence_rel", "ordinal"])


def arc2segm(seqs: DataFrame, geometry: str) -> DataFrame:
    segments = seqs.select(F.col(ID).alias("sequence_rel"), F.posexplode(_pairs(F.col(geometry))).alias("ordinal", "_e"))
    return with_ordinal(segments.select("sequence_rel", "ordinal", F.col("_e.p").alias("point"), F.col("_e.q").alias("next_point")), ["sequence_rel", "ordinal"])


def dyna_point(lines: DataFrame, a: str, b: str, step: float, ends: bool = False) -> DataFrame:
    """Points every `step` along each line from a, and its end if ends."""
    length = dist(F.col(a), F.col(b))
    at = F.transform(F.sequence(F.lit(0), F.floor(length / step).cast("int")), lambda i: i * step)
    at = F.array_distinct(F.concat(at, F.array(length))) if ends else at
    rows = lines.select(F.col(ID).alias("sequence_rel"), F.posexplode(at).alias("ordinal", "_d"), F.col(a).alias("_a"), F.col(b).alias("_b"), length.alias("_l"))
    part = F.coalesce(F.try_divide("_d", "_l"), F.lit(0.0))
    return with_ordinal(rows.select("sequence_rel", "ordinal", point(F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * part, F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * part).alias("point")), ["sequence_rel", "ordinal"])


def dyna_segment(lines: DataFrame, a: str, b: str, step: float, ends: bool = False) -> DataFrame:
    """The stretches between the points of dyna_point: sequence_rel, ordinal, point, next_point."""
    points = dyna_point(lines, a, b, step, ends).select("sequence_rel", "ordinal", "point")
    then = points.select("sequence_rel", (F.col("ordinal") - 1).alias("ordinal"), F.col("point").alias("next_point"))
    return with_ordinal(points.join(then, ["sequence_rel", "ordinal"]), ["sequence_rel", "ordinal"])


def inside(p: Column, ring: Column) -> Column:
    """Whether a point lies within a ring, by the parity of the sides a ray to the right meets."""
    crossed = lambda e: ((e["p"]["y"] > p["y"]) != (e["q"]["y"] > p["y"])) & (p["x"] < (e["q"]["x"] - e["p"]["x"]) * (p["y"] - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) + e["p"]["x"])
    return F.aggregate(_pairs(_closed(ring)), F.lit(False), lambda s, e: s != F.coalesce(crossed(e), F.lit(False)))


def point_in_all_polygons(points: DataFrame, geometry: str, polygons: DataFrame, ring: str, cell: float) -> DataFrame:
    """(first_rel, second_rel): points with each polygon they lie in; they meet by the cells of the polygons' boxes."""
    p = points.select(F.col(ID).alias("first_rel"), F.col(geometry).alias("_p"))
    p = p.withColumn("_cx", F.floor(F.col("_p.x") / cell).cast("bigint")).withColumn("_cy", F.floor(F.col("_p.y") / cell).cast("bigint"))
    lo, hi = lower_bound(F.col(ring)), upper_bound(F.col(ring))
    q = polygons.select(F.col(ID).alias("second_rel"), F.col(ring).alias("_r"), lo.alias("_lo"), hi.alias("_hi"))
    span = lambda axis: F.sequence(F.floor(F.col(f"_lo.{axis}") / cell).cast("bigint"), F.floor(F.col(f"_hi.{axis}") / cell).cast("bigint"))
    q = q.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    return p.join(q, ["_cx", "_cy"]).filter(inside(F.col("_p"), F.col("_r"))).select("first_rel", "second_rel")


def point_in_polygon(points: DataFrame, geometry: str, polygons: DataFrame, ring: str, cell: float) -> DataFrame:
    """(_id, polygon_rel): the first polygon each point lies in."""
    found = point_in_all_polygons(points, geometry, polygons, ring, cell).groupBy(F.col("first_rel").alias(ID)).agg(F.min("second_rel").alias("polygon_rel"))
    return points.select(ID).join(found, ID, "left")


def point_in_ranked_polygon(points: DataFrame, geometry: str, polygons: DataFrame, ring: str, rank: str, cell: float) -> DataFrame:
    """(_id, polygon_rel): of the polygons that a point lies in the one of the greatest rank, the first of equals."""
    found = point_in_all_polygons(points, geometry, polygons, ring, cell).join(polygons.select(F.col(ID).alias("second_rel"), F.col(rank).alias("_rank")), "second_rel")
    best = found.groupBy(F.col("first_rel").alias(ID)).agg(F.max(F.struct("_rank", (-F.col("second_rel")).alias("n"))).alias("m"))
    return points.select(ID).join(best.select(ID, (-F.col("m.n")).alias("polygon_rel")), ID, "left")


def buffer_point(p: Column, radius: float, n: int) -> Column:
    """A regular polygon of n corners around a point."""
    turn = 2 * math.pi / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(p["x"] + radius * F.cos(i * turn), p["y"] + radius * F.sin(i * turn)))
