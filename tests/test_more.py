"""Files, text, polygons, connections and scripts on small tables, against plain versions and round trips."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.core import ID, cut, discard
from gridloom.functions import macros, units
from gridloom.operators import breaks, connect, geometry, grid, network, polygon
from gridloom.operators.select import integrity_check
from gridloom.plans import script
from gridloom.plans.model import Model
from gridloom.sources import files, io, text


def square(x, y, s):
    return [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]


def rings(value):
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in value]


def shapes(spark, *values):
    return spark.createDataFrame([(i, rings(v) if v is not None else None) for i, v in enumerate(values)], f"_id bigint, geometry {polygon.RINGS}")


def test_cut_has_real_sizes(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    out = df
    for _ in range(6):  # a checkpoint's estimate would have doubled its digits each time
        out = cut(out.join(df.select("id"), "id"))
    assert out.count() == 1000 and out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 24
    kept = cut(out, out)
    discard(kept)
    with pytest.raises(Exception, match="(?i)not.*exist|FileNotFound"):
        kept.collect()


def test_shapefiles(spark, tmp_path):
    df = shapes(spark, square(0, 0, 4), None, square(2, 2, 1) + [[(9, 9), (10, 9), (9, 10)]])
    files.write_shp(df, f"{tmp_path}/a.shp", "geometry")
    got = files.read_shp(spark, f"{tmp_path}/a.shp").orderBy(ID).collect()
    assert [r.kind for r in got] == [5, 0, 5] and got[1].geometry is None
    assert [[(p.x, p.y) for p in ring] for ring in got[2].geometry] == [[*square(2, 2, 1)[0], (2, 2)], [(9, 9), (10, 9), (9, 10), (9, 9)]]
    points = shapes(spark, [[(1, 2)]], [[(3, 4)]])
    files.write_shp(points, f"{tmp_path}/p.shp", "geometry", kind=1)
    assert [(r.geometry[0][0].x, r.geometry[0][0].y) for r in files.read_shp(spark, f"{tmp_path}/p.shp").orderBy(ID).collect()] == [(1, 2), (3, 4)]
    files.write_shp(points.filter("false"), f"{tmp_path}/e.shp", "geometry")
    assert files.read_shp(spark, f"{tmp_path}/e.shp").count() == 0


@pytest.mark.parametrize("kind", ["f8", "f4", "u1", "i2"])
def test_tif(spark, tmp_path, kind):
    cells = [(r, c, None if (r, c) == (1, 2) else float(r * 5 + c)) for r in range(130) for c in range(5)]
    cells = [(r, c, v if v is None else v % 100) for r, c, v in cells]
    df = spark.createDataFrame(cells, "row int, col int, value double")
    files.write_tif(df, f"{tmp_path}/a.tif", kind=kind, nodata=255.0 if kind == "u1" else -9999.0)
    got = files.read_tif(spark, f"{tmp_path}/a.tif")
    assert sorted((r.row, r.col, -1 if r.value is None else r.value, r[ID]) for r in got.collect()) == sorted((r, c, -1 if v is None else v, r * 5 + c) for r, c, v in cells)


def test_tif_of_tiles_and_packed_bits(spark, tmp_path):
    def tif(tags, blocks):
        raw, starts = b"II*\0" + bytes(4), []
        for b in blocks:
            starts.append(len(raw))
            raw += b
        tags = {t: (k, starts if v == "starts" else [len(b) for b in blocks] if v == "counts" else v) for t, (k, v) in tags.items()}
        at, extra = len(raw), b""
        entries = b""
        for t in sorted(tags):
            k, v = tags[t]
            data = struct.pack(f"<{len(v)}{k}", *v)
            place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", at + 2 + 12 * len(tags) + 4 + len(extra))
            extra += data if len(data) > 4 else b""
            entries += struct.pack("<HHI", t, {"H": 3, "I": 4}[k], len(v)) + place
        return raw[:4] + struct.pack("<I", at) + raw[8:] + struct.pack("<H", len(tags)) + entries + bytes(4) + extra

    cells = np.arange(20 * 18, dtype=np.uint16).reshape(20, 18)
    padded = np.pad(cells, ((0, 12), (0, 14)))
    blocks = [zlib.compress(padded[r : r + 16, c : c + 16].tobytes()) for r in (0, 16) for c in (0, 16)]
    size = {256: ("H", [18]), 257: ("H", [20]), 277: ("H", [1])}
    (tmp_path / "t.tif").write_bytes(tif({**size, 258: ("H", [16]), 259: ("H", [8]), 322: ("H", [16]), 323: ("H", [16]), 324: ("I", "starts"), 325: ("I", "counts")}, blocks))
    packed = b"".join(bytes([17]) + bytes(range(r, r + 18)) if r % 2 else bytes([256 - 17, r]) for r in range(20))
    (tmp_path / "p.tif").write_bytes(tif({**size, 258: ("H", [8]), 259: ("H", [32773]), 273: ("I", "starts"), 278: ("H", [20]), 279: ("I", "counts")}, [packed]))
    got = {(r.row, r.col): r.value for r in files.read_tif(spark, f"{tmp_path}/t.tif").collect()}
    assert got == {(r, c): cells[r, c] for r in range(20) for c in range(18)}
    got = {(r.row, r.col): r.value for r in files.read_tif(spark, f"{tmp_path}/p.tif").collect()}
    assert got == {(r, c): r + c if r % 2 else r for r in range(20) for c in range(18)}


def test_other_files(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, float(3 * r + c)) for r in range(2) for c in range(3)], "row int, col int, value double")
    files.write_bmp(cells, f"{tmp_path}/a.bmp", palette=[0x010203 * k for k in range(6)])
    assert sorted((r.row, r.col, r.value) for r in files.read_bmp(spark, f"{tmp_path}/a.bmp").collect()) == sorted(tuple(r) for r in cells.collect())
    assert [r.rgb for r in files.read_palette(spark, f"{tmp_path}/a.bmp").orderBy(ID).collect()] == [0x010203 * k for k in range(6)]
    files.write_ascii_grid(cells.withColumn("value", F.when(F.col("value") != 4, F.col("value"))), f"{tmp_path}/a.asc")
    assert [r.value for r in io.read_ascii_grid(spark, f"{tmp_path}/a.asc").orderBy(ID).collect()] == [0, 1, 2, 3, None, 5]
    rows = spark.createDataFrame([(0, "one", 1.5, True), (1, None, None, None), (2, "three", -2.25, False)], "_id bigint, NAME string, X double, YES boolean")
    files.write_dbf(rows, f"{tmp_path}/a.dbf")
    assert [tuple(r) for r in io.read_dbf(spark, f"{tmp_path}/a.dbf").collect()] == [tuple(r)[1:] for r in rows.collect()]
    files.write_strings(rows.select("NAME", F.coalesce("NAME", F.lit("")).alias("t")).filter("NAME IS NOT NULL"), f"{tmp_path}/texts", "NAME", "t")
    assert sorted(r.text for r in io.read_strings(spark, f"{tmp_path}/texts").collect()) == ["one", "three"]
    arc = "EXP  0 x\nARC  2\n" + "".join(f"{v:10d}" for v in (1, 7, 3, 4, 0, 0, 3)) + "\n" + "".join(f"{v:14.7E}" for v in (0, 0, 1.5, 2)) + "\n" + "".join(f"{v:14.7E}" for v in (3, 4)) + "\n" + "".join(f"{v:10d}" for v in (-1, 0, 0, 0, 0, 0, 0)) + "\nEOS\n"
    (tmp_path / "a.e00").write_text(arc)
    assert [(r[ID], r.from_node, r.to_node, [(p.x, p.y) for p in r.geometry]) for r in files.read_e00(spark, f"{tmp_path}/a.e00").collect()] == [(1, 3, 4, [(0, 0), (1.5, 2), (3, 4)])]
    (tmp_path / "a.geojson").write_text('{"features":[{"properties":{"n":1},"geometry":{"type":"Point","coordinates":[1,2]}},{"properties":{"n":2},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,1],[0,0]]]}},{"properties":{"n":3},"geometry":null}]}')
    got = files.read_geojson(spark, f"{tmp_path}/a.geojson", "n:int").orderBy(ID).collect()
    assert [(r.n, r.geometry and [[(p.x, p.y) for p in ring] for ring in r.geometry]) for r in got] == [(1, [[(1, 2)]]), (2, [[(0, 0), (1, 0), (0, 1), (0, 0)]]), (3, None)]
    assert files.make_dir(spark, f"{tmp_path}/d") and files.init_file(spark, f"{tmp_path}/d/x", b"ab") and not files.init_file(spark, f"{tmp_path}/d/x")
    assert files.copy_file(spark, f"{tmp_path}/d/x", f"{tmp_path}/d/y") and files.existing_file(spark, f"{tmp_path}/d/y") and (tmp_path / "d/y").read_bytes() == b"ab"
    assert files.full_path_name(spark, f"{tmp_path}/d").endswith("/d") and files.current_dir(spark)


def test_text(spark):
    df = spark.createDataFrame([(0, "12, 'a b' 7.5", 4), (1, "null x", 0), (2, None, 0), (3, "", 0)], "_id bigint, t string, p int")
    assert [r.value for r in text.read_elems(df, "t", "p", "string").orderBy(ID).collect()] == ["a b", "null", None, None]
    got = text.read_elems(df, "t", 0, "int32", after="q").orderBy(ID).collect()
    assert [(r.value, r.q) for r in got] == [(12, 2), (None, 4), (None, None), (None, 0)]
    values = text.read_array(spark.createDataFrame([(0, "1 2, null 4"), (1, "5")], "_id bigint, t string"), "t", F.lit(3), "int32").orderBy("org_rel", "ordinal").collect()
    assert [r.value for r in values] == [1, 2, None, 5, None, None]
    assert text.read_value(df, "t", "int32").filter("org_rel = 0").first().value == 12
    lines = spark.createDataFrame([(0, [1, None, None, 2, 3]), (1, []), (2, [4])], "_id bigint, s array<int>")
    assert [(r.org_rel, r.geometry) for r in text.split_multi_linestring(lines, "s").orderBy(ID).collect()] == [(0, [1]), (0, [2, 3]), (2, [4])]
    xml = spark.createDataFrame([(0, "<r><town><name>A</name><street><n>1</n></street><street><n>2</n></street></town><town><name>B</name></town></r>"), (1, None)], "_id bigint, x string")
    tables = text.xml_tables(xml, "x", {"town": {"name": "string"}, "town/street": {"n": "int"}}, "r")
    assert [(r.parent_rel, r.name) for r in tables["town"].orderBy(ID).collect()] == [(0, "A"), (0, "B")]
    assert [(r.parent_rel, r.n) for r in tables["town/street"].orderBy(ID).collect()] == [(0, 1), (0, 2)]


def test_polygons_against_points():
    """Random stars under all rules: which of many places are inside is what the rule says."""
    rng = np.random.default_rng(1)
    places = rng.random((4000, 2)) * 9 - 4

    def star():
        turn, far = np.sort(rng.random(9)) * 2 * np.pi, rng.random(9) * 3 + 1
        return [np.stack([far * np.cos(turn) + rng.random(), far * np.sin(turn) + rng.random()], axis=1)]

    for _ in range(12):
        pair = [star(), star()]
        inside = np.stack([polygon._within(places, polygon._sides(p)) for p in pair])
        for rule in polygon.RULES.values():
            got = polygon.arranged(pair, rule)
            assert ((polygon._within(places, polygon._sides(got)) if got else np.zeros(len(places), bool)) == rule(inside)).all()


def test_polygon_rows(spark):
    df = shapes(spark, square(0, 0, 6) + square(2, 2, 2), square(4, 0, 4), square(20, 20, 1) + square(30, 30, 1), None, [])
    area = lambda c: F.aggregate(c, F.lit(0.0), lambda s, r: s + geometry.signed_area(r))
    assert [r[0] for r in polygon.cleaned(df, "geometry", "g").orderBy(ID).select(area("g")).collect()] == [32, 16, 2, None, 0]
    assert [r[0] for r in polygon.outer_polygon(df, "geometry", "g").orderBy(ID).select(area("g")).collect()] == [36, 16, 2, None, 0]
    parts = polygon.split_polygon(df.filter("geometry IS NOT NULL"), "geometry").orderBy(ID).collect()
    assert [(r.polygon_rel, len(r.geometry)) for r in parts] == [(0, 2), (1, 1), (2, 1), (2, 1)]
    both = polygon.union_polygon(df.withColumn("k", F.col(ID) % 2), "geometry", "k", batch=2).select("part", area("geometry").alias("a")).orderBy("part").collect()
    assert [tuple(r) for r in both] == [(0, 34), (1, 16)]
    assert polygon.union_polygon(df.filter("false"), "geometry").count() == 0
    met = polygon.overlay_polygon(df, df.filter("_id = 1"), "geometry", 3.0).select("first_rel", area("geometry")).orderBy("first_rel").collect()
    assert [tuple(r) for r in met] == [(0, 8), (1, 16)]
    assert [tuple(r) for r in polygon.polygon_connectivity(df, "geometry", 3.0).collect()] == [(0, 1)]
    grown = polygon.buffer_polygon(df, "geometry", -1.0, 16, "g").orderBy(ID).select(area("g")).collect()
    assert grown[1][0] == pytest.approx(4, abs=0.01) and grown[2][0] == 0
    line = spark.createDataFrame([(0, [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0), (3.0, 2.0), (4.0, 0.0)])], "_id bigint, l array<struct<x:double,y:double>>")
    assert [(p.x, p.y) for p in polygon.simplify_linestring(line, "l", 0.5, "s").first().s] == [(0, 0), (2, 0), (3, 2), (4, 0)]
    assert polygon.buffer_linestring(line, "l", 0.01, 8, "b").select(area("b")).first()[0] == pytest.approx(0.02 * (2 * 1.005 + 2 * math.sqrt(5)), rel=0.02)
    assert polygon.buffer_points(line, "l", 0.1, 64, "b").select(area("b")).first()[0] == pytest.approx(5 * math.pi * 0.01, rel=0.01)
    cells = polygon.poly2allgrids(df, "geometry", 7, 7).collect()
    assert {(r.row, r.col) for r in cells if r.polygon_rel == 0} == {(r, c) for r in range(6) for c in range(6) if not (2 <= r < 4 and 2 <= c < 4)}
    assert {(r.row, r.col): r.polygon_rel for r in polygon.poly2grid(df, "geometry", 7, 7).collect()}[0, 5] == 1


def test_places(spark):
    df = spark.createDataFrame([(0, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (1, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (8.0, 9.0), (8.0, 1.0), (0.0, 1.0)]), (2, [(0.0, 0.0), (1.0, 1.0)])], "_id bigint, r array<struct<x:double,y:double>>")
    mid = [r[0] and tuple(r[0]) for r in df.orderBy(ID).select(geometry.mid(F.col("r"))).collect()]
    assert mid == [(2, 2), (8.5, 4.5), None]
    assert [r[0] and tuple(r[0]) for r in df.orderBy(ID).select(geometry.centroid_or_mid(F.col("r"))).collect()] == mid
    lines = spark.createDataFrame([(0, (0.0, 0.0), (5.0, 0.0))], "_id bigint, a struct<x:double,y:double>, b struct<x:double,y:double>")
    assert [(r.point.x, r.next_point.x) for r in geometry.dyna_segment(lines, "a", "b", 2.0, ends=True).orderBy(ID).collect()] == [(0, 2), (2, 4), (4, 5)]
    ranked = spark.createDataFrame([(0, rings(square(0, 0, 9))[0], 1), (1, rings(square(2, 2, 3))[0], 5), (2, rings(square(2, 2, 3))[0], 5)], "_id bigint, g array<struct<x:double,y:double>>, k int")
    points = spark.createDataFrame([(0, (3.0, 3.0)), (1, (8.0, 8.0)), (2, (50.0, 0.0))], "_id bigint, p struct<x:double,y:double>")
    assert [r.polygon_rel for r in geometry.point_in_ranked_polygon(points, "p", ranked, "g", "k", 4.0).orderBy(ID).collect()] == [1, 0, None]


def test_connect_info(spark):
    arcs = spark.createDataFrame([(0, [(0.0, 0.0), (10.0, 0.0)], 1), (1, [(0.0, 5.0), (5.0, 5.0), (10.0, 5.0)], 2)], "_id bigint, l array<struct<x:double,y:double>>, k int")
    points = spark.createDataFrame([(0, (3.0, 1.0), 2), (1, (-3.0, 0.0), 1), (2, (5.0, 9.0), 2), (3, None, 1), (4, (100.0, 0.0), 1)], "_id bigint, p struct<x:double,y:double>, k int")
    got = connect.connect_info(arcs, "l", points, "p", 2.0).orderBy(ID).collect()
    assert [(r.dist, r.ArcID, r.SegmID, r.InArc, r.InSegm) for r in got] == [(1, 0, 0, True, True), (3, 0, 0, False, False), (4, 1, 0, True, False), (None,) * 5, (90, 0, 0, False, False)]
    same = connect.connect_info(arcs, "l", points, "p", 2.0, limit=50.0, arc_key="k", point_key="k").orderBy(ID).collect()
    assert [(r.dist, r.ArcID) for r in same] == [(4, 1), (3, 0), (4, 1), (None, None), (None, None)]
    assert connect.dist_info(arcs, "l", points, "p", 2.0, arc_key="k", point_key="k", same=False).orderBy(ID).first().dist == 1
    out = connect.connect_arcs(arcs, "l", points.filter("_id IN (0, 2)"), "p", 2.0).orderBy(ID).collect()
    assert [([(p.x, p.y) for p in r.geometry], r.arc_rel, r.point_rel) for r in out] == [
        ([(0, 0), (3, 0)], 0, None), ([(3, 0), (10, 0)], 0, None), ([(0, 5), (5, 5)], 1, None), ([(5, 5), (10, 5)], 1, None), ([(3, 1), (3, 0)], None, 0), ([(5, 9), (5, 5)], None, 2),
    ]


def test_breaks_deal_out_what_is_left(spark):
    df = spark.createDataFrame([(float(v),) for v, n in ((1, 97), (2, 1), (3, 1), (4, 1)) for _ in range(n)] + [(0.0,), (None,)], "x double")
    assert [r.bound for r in breaks.equal_count(df.filter("x > 0"), "x", 4).orderBy(ID).collect()] == [1, 2, 3, 4]
    assert [r.bound for r in breaks.equal_count(df, "x", 6, nonzero=True).orderBy(ID).collect()] == [0, 1, 2, 3, 4, 4]
    assert [r.bound for r in breaks.equal_count(df.filter("false"), "x", 2).orderBy(ID).collect()] == [None, None]


def test_limit_of_grid_distance(spark):
    cells = spark.createDataFrame([(0, c, 1.0, c == 0) for c in range(4)], "row int, col int, v double, s boolean")
    assert [r.dist for r in grid.grid_distance(cells, "v", "s", limit=2.0).orderBy("col").collect()] == [0, 1, None, None]


def test_integrity_check_fails(spark):
    df = spark.createDataFrame([(0, 1), (1, -1)], "_id bigint, x int")
    with pytest.raises(Exception, match="(?i)check|assert|integrity|fail"):
        integrity_check(df, F.col("x") > 0).collect()


def test_typed_sum_overflows(spark):
    df = spark.createDataFrame([(0, 200), (0, 100)], "r bigint, x int")
    with pytest.raises(Exception, match="doesn't fit"):
        macros.typed_sum(df, "x", "uint8", "r", spark.range(1).withColumnRenamed("id", ID)).collect()


def test_units(spark):
    km, metre = 1000.0 * units.base_unit("m"), units.base_unit("m")
    with pytest.raises(ValueError, match="converted"):
        units.convert(F.lit(1.0), km, units.base_unit("s"))
    point = F.struct(F.lit(2.0).alias("x"), F.lit(3.0).alias("y"))
    of = units.gridset(metre, (10.0, 20.0), (1.0, 2.0), "base")
    got = spark.range(1).select(units.convert(F.lit(1.5), km, metre).alias("a"), units.convert_point(point, of, metre).alias("b"), units.of_unit(F.lit(300), units.default_unit("uint8")).alias("c")).first()
    assert got.a == 1500 and tuple(got.b) == (42, 31) and got.c is None
    assert units.bound_range(units.range_(metre, 3, 9)) == 6 and units.bound_center(units.range_(metre, 3, 9)) == 6
    tiled = units.tiled(spark.range(64).select((F.col("id") % 8).alias("row"), F.floor(F.col("id") / 8).alias("col")), 4)
    assert tiled.groupBy(F.spark_partition_id(), F.floor(F.col("row") / 4), F.floor(F.col("col") / 4)).count().count() == 4


def test_trips(spark):
    matrix = spark.createDataFrame([(0, 0, 0.0), (0, 1, 2.0), (0, 2, 4.0), (1, 2, 1.0)], "origin bigint, destination bigint, impedance double")
    origins = spark.createDataFrame([(0, 30.0), (1, 10.0), (2, 5.0)], "_id bigint, s double")
    to = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 4.0)], "_id bigint, d double")
    trips, d, x = network.trip_distribution(matrix, origins, "s", to, "d", 1.0)
    assert {(r.origin, r.destination): r.M_ij for r in trips.collect()} == {(0, 0): 0, (0, 1): 10, (0, 2): 20, (1, 2): 10}
    assert [(r.D_i, r.M_ix) for r in d.orderBy(ID).collect()] == [(1.5, 30), (4, 10), (0, 0)] and [r.M_xj for r in x.orderBy(ID).collect()] == [0, 10, 30]


def test_scripts(spark):
    model = Model({"d": spark.range(3).withColumnRenamed("id", ID).withColumn("x", F.col(ID) * 2)})
    with pytest.raises(ValueError, match="arguments"):
        script.for_each("for_each_ne", ["a"])
    with pytest.raises(ValueError, match="twice"):
        script.for_each("for_each_n", ["a", "a"])
    with pytest.raises(KeyError, match="no template"):
        script.instantiate({}, "t")
    with pytest.raises(ValueError, match="constant"):
        script.constant("x + 1", spark)
    items = script.for_each_ind("ndv", ["a", "b"], "d", "uint8")
    items.props["unit"] = "m"
    assert script.inherited_prop(items, "a", "unit") == "m" and script.prop_value(items["a"], "values") == "uint8"
    made = script.for_each("for_each_nt", ["a", "b"], lambda name: script.container((name, script.Rule("d", "x + 1"))))
    assert [r.value for r in script.evaluated(model, made.item("b/b")).orderBy(ID).collect()] == [1, 3, 5]
    inner = script.scope(model, script.container(("d", model.domains["d"].withColumn("x", F.lit(7)))), script.Rule("d", "x"))
    assert {r.value for r in inner.collect()} == {7}
    assert script.expand("%a%/%b%", a=1) == "1/%b%"
    assert script.doc_data(spark).filter("name = 'sqrt'").count() == 1 and script.doc_storage_managers(spark).filter("name = 'read_tif'").count() == 1


def test_least_claims(spark):
    """Twelve cells that all prefer a town: at most six of it, and a forest of two at least."""
    from gridloom.operators import allocation

    rng = np.random.default_rng(4)
    worth = {u: rng.random(12) + (2 if u == "town" else 0) for u in ("town", "field", "forest")}
    worth["forest"] -= 1
    df = spark.createDataFrame([(i, u, float(worth[u][i])) for u in worth for i in range(12)], "_id bigint, use string, suitability double")
    most, least = {"town": 6, "field": 12, "forest": 12}, {"forest": 2}
    chosen, prices = allocation.discrete_alloc(df, most, least)
    got = {r[0]: r.use for r in chosen.collect()}
    at = {u: sum(x == u for x in got.values()) for u in worth}
    assert len(got) == 12 and at["town"] <= 6 and at["forest"] >= 2
    assert all(worth[got[i]][i] - prices[got[i]] >= max(worth[u][i] - prices[u] for u in worth) - 1e-5 for i in got)
    types, cells = allocation.allocation_report(df, chosen, prices, most, least)
    assert {r.use: r.total_allocated for r in types.collect()} == at and cells.count() == 12
    with pytest.raises(RuntimeError, match="claims"):
        allocation.discrete_alloc(df, {"town": 6, "field": 2, "forest": 1}, rounds=4)
