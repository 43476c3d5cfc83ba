"""The nearest arc, point or place under conditions, and what can be told of it; places in a quad tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import ID, cut, with_ordinal
from .geometry import arc2segm, point


def _foot(p: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """How far along from a to b the place nearest to p is, and its squared distance from p."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    part = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
    ex, ey = a["x"] + part * dx - p["x"], a["y"] + part * dy - p["y"]
    return part, ex * ex + ey * ey


def connect_info(arcs: DataFrame, line: str, points: DataFrame, geometry: str, cell: float, limit: float | None = None, arc_key: str | None = None, point_key: str | None = None, same: bool = True) -> DataFrame:
    """(_id, dist, ArcID, SegmID, CutPoint, InArc, InSegm): of each point the nearest arc; ties to the least arc and segment.

    InArc: whether the nearest place isn't an end of the arc; InSegm: nor one of its segment. With
    keys only arcs of the point's key count (same), or of another (not same). Points look in rings
    of cells, each as wide as the ones before together, until the nearest found is nearer than the
    next ring could hold; a segment is in the cells that its box has. With a limit, points without
    an arc that near have none.
    """
    segments = arc2segm(arcs.select(ID, line), line).join(arcs.select(F.col(ID).alias("sequence_rel"), *([F.col(arc_key).alias("_ak")] if arc_key else [])), "sequence_rel")
    sizes = arcs.select(F.col(ID).alias("sequence_rel"), (F.size(line) - 2).alias("_last"))
    segments = segments.join(sizes, "sequence_rel").withColumnRenamed("sequence_rel", "ArcID").withColumnRenamed("ordinal", "SegmID").drop(ID)
    span = lambda axis: F.sequence(F.floor(F.least(F.col(f"point.{axis}"), F.col(f"next_point.{axis}")) / cell).cast("bigint"), F.floor(F.greatest(F.col(f"point.{axis}"), F.col(f"next_point.{axis}")) / cell).cast("bigint"))
    held = cut(segments.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y"))))
    left = points.select(ID, F.col(geometry).alias("_p"), *([F.col(point_key).alias("_pk")] if point_key else [])).filter("_p IS NOT NULL")
    xy = lambda d, p: [f(F.col(f"{p}.{a}")) for a in "xy" for f in (F.min, F.max)]
    box, frame = held.agg(*xy(held, "point"), *xy(held, "next_point")).first(), left.agg(*xy(left, "_p")).first()
    none = points.select(ID)
    if box[0] is None or frame[0] is None:
        return none.select(ID, *[F.lit(None).cast(t).alias(n) for n, t in (("dist", "double"), ("ArcID", "bigint"), ("SegmID", "int"), ("CutPoint", "struct<x:double,y:double>"), ("InArc", "boolean"), ("InSegm", "boolean"))])
    reach = max(max(box[k + 1], box[k + 5], frame[k + 1]) - min(box[k], box[k + 4], frame[k]) for k in (0, 2))
    most = math.ceil((min(reach, limit) if limit is not None else reach) / cell) + 1
    done, open_, ring = None, left, 1
    while True:
        r = min(ring, most)
        around = F.explode(F.sequence(F.lit(-r), F.lit(r)))
        probe = open_.withColumn("_i", around).withColumn("_j", around)
        probe = probe.withColumn("_cx", F.floor(F.col("_p.x") / cell).cast("bigint") + F.col("_i")).withColumn("_cy", F.floor(F.col("_p.y") / cell).cast("bigint") + F.col("_j"))
        pairs = probe.join(held, ["_cx", "_cy"])
        if arc_key:
            pairs = pairs.filter(F.col("_ak") == F.col("_pk") if same else F.col("_ak") != F.col("_pk"))
        part, square = _foot(F.col("_p"), F.col("point"), F.col("next_point"))
        best = pairs.groupBy(ID).agg(F.min(F.struct(square.alias("d2"), "ArcID", "SegmID", part.alias("part"), "point", "next_point", "_last")).alias("m"))
        final = best if r >= most else best.filter(F.col("m.d2") <= (r * cell) ** 2)
        done = cut(final if done is None else done.unionByName(final))
        open_ = cut(open_.join(done, ID, "left_anti"))
        if r >= most or open_.isEmpty():
            break
        ring = 3 * ring + 1
    m = done.select(ID, "m.*")
    if limit is not None:
        m = m.filter(F.col("d2") <= limit * limit)
    at = point(F.col("point.x") + F.col("part") * (F.col("next_point.x") - F.col("point.x")), F.col("point.y") + F.col("part") * (F.col("next_point.y") - F.col("point.y")))
    in_segm = (F.col("part") > 0) & (F.col("part") < 1)
    in_arc = in_segm | ((F.col("part") == 0) & (F.col("SegmID") > 0)) | ((F.col("part") == 1) & (F.col("SegmID") < F.col("_last")))
    told = m.select(ID, F.sqrt("d2").alias("dist"), "ArcID", "SegmID", at.alias("CutPoint"), in_arc.alias("InArc"), in_segm.alias("InSegm"))
    return none.join(told, ID, "left")


def dist_info(*args, **options) -> DataFrame:
    """connect_info's distance alone."""
    return connect_info(*args, **options).select(ID, "dist")


def connect_arcs(arcs: DataFrame, line: str, points: DataFrame, geometry: str, cell: float, limit: float | None = None) -> DataFrame:
    """The arcs cut where points meet them, and a link from each point to its place: _id, geometry, arc_rel, point_rel.

    Pieces of arcs come first, in order, with arc_rel; then the links, with point_rel.
    """
    info = cut(connect_info(arcs, line, points, geometry, cell, limit).filter("ArcID IS NOT NULL"))
    cuts = info.filter("InArc").groupBy(F.col("ArcID").alias(ID)).agg(F.array_sort(F.collect_set(F.struct(F.col("SegmID").alias("s"), F.col("CutPoint").alias("p")))).alias("_c"))
    seq = arcs.select(ID, F.col(line).alias("_l")).join(cuts, ID, "left")
    # Vertices and cuts in the order along the arc: by segment, then by the distance from the segment's beginning.
    vertex = F.transform("_l", lambda p, i: F.struct(i.alias("s"), F.lit(0.0).alias("d"), F.lit(False).alias("cut"), p.alias("p")))
    start = lambda c: F.get(F.col("_l"), c["s"])
    added = F.transform(F.coalesce("_c", F.array().cast("array<struct<s:int,p:struct<x:double,y:double>>>")), lambda c: F.struct(c["s"].alias("s"), F.sqrt((c["p"]["x"] - start(c)["x"]) ** 2 + (c["p"]["y"] - start(c)["y"]) ** 2).alias("d"), F.lit(True).alias("cut"), c["p"].alias("p")))
    every = F.array_sort(F.concat(vertex, added))
    rows = seq.select(ID, F.posexplode(every).alias("_k", "e"), F.size(every).alias("_n"))
    place = rows.filter((F.col("e.cut")) | (F.col("_k") == 0) | (F.col("_k") == F.col("_n") - 1)).groupBy(ID).agg(F.array_sort(F.collect_list("_k")).alias("_at"))
    cut_up = seq.join(place, ID).select(ID, every.alias("_e"), "_at")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_at") - 2, F.lit(0))), lambda i: F.transform(F.slice("_e", F.get("_at", i) + 1, F.get("_at", i + 1) - F.get("_at", i) + 1), lambda e: e["p"]))
    # A cut at a vertex is there twice.
    parts = F.transform(parts, lambda part: F.filter(part, lambda p, i: (i == 0) | (p != F.get(part, i - 1))))
    pieces = cut_up.filter(F.size("_at") > 1).select(F.lit(0).alias("_o"), F.col(ID).alias("arc_rel"), F.posexplode(parts).alias("_k", "geometry"), F.lit(None).cast("bigint").alias("point_rel"))
    own = points.select(ID, F.col(geometry).alias("_p"))
    links = info.join(own, ID).select(F.lit(1).alias("_o"), F.lit(None).cast("bigint").alias("arc_rel"), F.lit(0).alias("_k"), F.array("_p", "CutPoint").alias("geometry"), F.col(ID).alias("point_rel"))
    return with_ordinal(pieces.unionByName(links), ["_o", "arc_rel", "point_rel", "_k"]).select(ID, "geometry", "arc_rel", "point_rel")


def capacitated_connect(a: DataFrame, ax: str, ay: str, need: str, b: DataFrame, bx: str, by: str, capacity: str, cell: float) -> DataFrame:
    """(_id, nearest_rel, dist): of each point of a the nearest of b whose capacity is its need at least; ties to the least ordinal."""
    left = a.select(ID, F.col(ax).alias("_ax"), F.col(ay).alias("_ay"), F.col(need).alias("_need"))
    right = b.select(F.col(ID).alias("_b"), F.col(bx).alias("_bx"), F.col(by).alias("_by"), F.col(capacity).alias("_cap"), F.floor(F.col(bx) / cell).cast("bigint").alias("_cx"), F.floor(F.col(by) / cell).cast("bigint").alias("_cy"))
    box, frame = b.agg(F.min(bx), F.max(bx), F.min(by), F.max(by)).first(), a.agg(F.min(ax), F.max(ax), F.min(ay), F.max(ay)).first()
    if box[0] is None or frame[0] is None:
        return left.select(ID, F.lit(None).cast("bigint").alias("nearest_rel"), F.lit(None).cast("double").alias("dist"))
    reach = max(max(box[1], frame[1]) - min(box[0], frame[0]), max(box[3], frame[3]) - min(box[2], frame[2]))
    most, ring, done, open_ = math.ceil(reach / cell) + 1, 1, None, left
    while True:
        r = min(ring, most)
        around = F.explode(F.sequence(F.lit(-r), F.lit(r)))
        probe = open_.withColumn("_i", around).withColumn("_j", around)
        probe = probe.withColumn("_cx", F.floor(F.col("_ax") / cell).cast("bigint") + F.col("_i")).withColumn("_cy", F.floor(F.col("_ay") / cell).cast("bigint") + F.col("_j"))
        d = F.sqrt((F.col("_ax") - F.col("_bx")) * (F.col("_ax") - F.col("_bx")) + (F.col("_ay") - F.col("_by")) * (F.col("_ay") - F.col("_by")))
        best = probe.join(right, ["_cx", "_cy"]).filter("_cap >= _need").groupBy(ID).agg(F.min(F.struct(d.alias("dist"), F.col("_b").alias("nearest_rel"))).alias("m")).select(ID, "m.nearest_rel", "m.dist")
        final = best if r >= most else best.filter(F.col("dist") <= r * cell)
        done = cut(final if done is None else done.unionByName(final))
        open_ = cut(open_.join(done, ID, "left_anti"))
        if r >= most or open_.isEmpty():
            return left.select(ID).join(done, ID, "left")
        ring = 3 * ring + 1


def spatial_index(df: DataFrame, lower: str, upper: str, level: int, name: str = "quad") -> DataFrame:
    """The quad-tree cell of each box (points lower and upper): the smallest one, down to a level, that holds it all.

    Cells are numbered from the root: a cell's four parts are 4 n + 1 to 4 n + 4, by x and then y,
    within the box around all boxes.
    """
    x0, x1 = F.col(f"{lower}.x"), F.col(f"{upper}.x")
    y0, y1 = F.col(f"{lower}.y"), F.col(f"{upper}.y")
    around = df.agg(F.min(x0).alias("a"), F.max(x1).alias("b"), F.min(y0).alias("c"), F.max(y1).alias("d"))
    rows = df.crossJoin(F.broadcast(around.select(F.struct("a", "b", "c", "d").alias("_box"))))  # one row
    cells = 1 << level
    place = lambda v, a, b: F.least(F.floor(F.coalesce(F.try_divide((v - F.col(f"_box.{a}")) * cells, F.col(f"_box.{b}") - F.col(f"_box.{a}")), F.lit(0.0))), F.lit(cells - 1)).cast("bigint")
    px, qx, py, qy = place(x0, "a", "b"), place(x1, "a", "b"), place(y0, "c", "d"), place(y1, "c", "d")
    out = F.lit(0).cast("bigint")
    number = F.lit(0).cast("bigint")
    for depth in range(1, level + 1):
        shift = level - depth
        number = number * 4 + 1 + F.shiftright(px, shift).bitwiseAND(F.lit(1).cast("bigint")) + 2 * F.shiftright(py, shift).bitwiseAND(F.lit(1).cast("bigint"))
        fits = (F.shiftright(px, shift) == F.shiftright(qx, shift)) & (F.shiftright(py, shift) == F.shiftright(qy, shift))
        out = F.when(fits, number).otherwise(out)
    return rows.withColumn(name, out).drop("_box")
