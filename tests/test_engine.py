import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.core import ID, with_ordinal
from gridloom.functions import elementwise as el
from gridloom.functions import strings as st
from gridloom.operators import aggregate as ag
from gridloom.operators import allocation as al
from gridloom.operators import breaks as br
from gridloom.operators import geometry as ge
from gridloom.operators import grid as gr
from gridloom.operators import lookup as lo
from gridloom.operators import matrix as ma
from gridloom.operators import network as ne
from gridloom.operators import order as od
from gridloom.operators import select as se
from gridloom.plans import model as mo
from gridloom.plans import queries as qu
from gridloom.sources import io


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(0, 3, "a", 0), (1, None, "b", 0), (2, 3, None, 1), (3, -5, "d", None), (4, 0, "e", 1)], "_id bigint, x int, s string, rel int")


def one(df, column):
    return [r[0] for r in df.orderBy(ID).select(column).collect()]


def test_comparisons_are_false_where_undefined(values):
    assert one(values, el.lt(F.col("x"), F.lit(1))) == [False, False, False, True, True]
    assert one(values, el.ne(F.col("x"), F.lit(3))) == [False, False, False, True, True]
    assert one(values, el.compared("eq", F.col("x"), F.lit(None).cast("int"), "both")) == [False, True, False, False, False]


def test_arithmetic_of_the_undefined(values):
    x = F.col("x")
    assert one(values, el.idiv(F.lit(-7), x)) == [-2, None, -2, 1, None]
    assert one(values, el.mod(F.lit(-7), x)) == [-1, None, -1, -2, None]
    assert one(values, el.log(x.cast("double")))[3:] == [None, None]
    assert one(values, el.add_or_null(x, F.lit(2**31 - 1)))[:2] == [None, None]
    assert one(values, el.round_(F.lit(-2.5))) == [-2] * 5
    assert one(values, el.cast(x, "uint8")) == [3, None, 3, None, 0]
    assert one(values, el.power(x, 3)) == [27, None, 27, -125, 0]


def test_choices(values):
    x = F.col("x")
    assert one(values, el.argmin(x, F.lit(3), F.lit(0))) == [2, 2, 2, 0, 0]
    assert one(values, el.min_elem(x, F.lit(1), defined="all")) == [1, None, 1, -5, 0]
    assert one(values, el.switch((x > 0, F.lit("p")), (x < 0, F.lit("n")), otherwise=F.lit("z"))) == ["p", "z", "p", "n", "z"]


def test_texts(spark):
    df = spark.createDataFrame([(0, "héllo l"), (1, ""), (2, None)], "_id bigint, s string")
    s = F.col("s")
    assert one(df, st.strpos(s, "l")) == [2, None, None]
    assert one(df, st.strrpos(s, "l")) == [6, None, None]
    assert one(df, st.strcount(s, "l")) == [3, 0, None]
    assert one(df, st.strlen(s)) == [8, 0, None]
    assert one(df, st.concat(s, F.lit("!"))) == ["héllo l!", "!", "!"]
    assert one(df, st.unquote(st.quote(s))) == ["héllo l", "", None]
    assert one(df, st.regex_search(s, "l+")) == ["ll", None, None]


def test_ordinals_and_selections(spark, values):
    many = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert rows(with_ordinal(many, ["k"]), ID, "k") == sorted(((i, i) for i in range(1000)), key=repr)
    picked = se.select_with_org_rel(values, F.col("x") >= 0)
    assert rows(picked, ID, "org_rel") == [(0, 0), (1, 2), (2, 4)]
    assert one(se.recollect_by_cond(values, picked, "x", F.lit(-1)), "x") == [3, -1, 3, -1, 0]
    assert se.select(values, F.lit(False)).count() == 0
    with pytest.raises(Exception, match="broken"):
        se.integrity_check(values, F.col("x") > 0, "broken").collect()


def test_relations(spark, values):
    keys = spark.createDataFrame([(0, 3), (1, 0), (2, 3), (3, None)], "_id bigint, k int")
    found = lo.rlookup(values.drop("rel"), "x", keys, "k")
    assert rows(found, ID, "rel") == sorted([(0, 0), (1, None), (2, 0), (3, None), (4, 1)], key=repr)
    found = lo.rlookup(values.drop("rel"), "x", keys, "k", null_matches=True)
    assert rows(found, ID, "rel") == sorted([(0, 0), (1, 3), (2, 0), (3, None), (4, 1)], key=repr)
    target = spark.range(3).withColumnRenamed("id", ID)
    assert rows(lo.invert(values, "rel", target), ID, "inverse") == sorted([(0, 1), (1, 4), (2, None)], key=repr)
    assert one(values, lo.classify(F.col("x"), [2, -10, 0])) == [0, None, 0, 1, 2]
    assert rows(lo.classify_by(values, "x", keys, "k"), ID, "class_rel") == sorted([(0, 2), (1, None), (2, 2), (3, None), (4, 1)], key=repr)


def test_near_points(spark):
    rng = np.random.default_rng(1)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-20, 20, (120, 2)))]
    df = spark.createDataFrame(points, "_id bigint, x double, y double")
    want = sorted((i, j) for i, a, b in points for j, c, d in points if (a - c) ** 2 + (b - d) ** 2 <= 9)
    assert [tuple(r) for r in lo.join_near_values(df, "x", "y", df, "x", "y", 3.0).orderBy(ID).select("first_rel", "second_rel").collect()] == want
    want = {i: min(((a - c) ** 2 + (b - d) ** 2, j) for j, c, d in points if j != i)[1] for i, a, b in points}
    assert {r[0]: r[1] for r in lo.nearest(df, "x", "y", df, "x", "y", 1.0, same=True).select(ID, "nearest_rel").collect()} == want


def test_connect_neighbour_of_all_parts(spark, tmp_path):
    rng = np.random.default_rng(12)
    parts = [(i, int(rng.integers(1, 51)), float(rng.integers(9000, 20000)) / 10) for i in range(700)]
    spark.createDataFrame(parts, "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    d = np.sqrt(np.array([[(a - c) ** 2 + (b / 10 - e / 10) ** 2 if i != j else np.inf for j, c, e in parts] for i, a, b in parts]))
    got = {r[ID]: (r.nearest_rel, r.dist) for r in qu.QUERIES["connect_neighbour"](spark, str(tmp_path)).collect()}
    assert len(got) == 700 and all(abs(got[i][1] - d[i].min()) < 1e-5 and d[i, got[i][0]] == d[i].min() for i in range(700))


def test_aggregates_are_dense(spark, values):
    target = spark.range(3).withColumnRenamed("id", ID)
    x = F.col("x")
    out = ag.along(values, "rel", target, s=("sum", x), n=("count", x), low=("min", x), f=("first", F.col("s")), a=("any", x > 1), e=("all", x > 1), i=("max_index", x))
    assert rows(out, ID, "s", "n", "low", "f", "a", "e", "i") == [(0, 3, 1, 3, "a", True, True, 0), (1, 3, 2, 0, "e", True, False, 2), (2, 0, 0, None, None, False, True, None)]
    assert rows(ag.modus(values, "x"), "modus", "modus_count") == [(3, 2)]
    assert one(ag.cumulate(values, "x"), "cumulated") == [3, 3, 6, 1, 1]
    assert rows(ag.nth_element(values, "x", 1), "nth_element") == [(0,)]
    empty = values.filter("false")
    assert rows(ag.total(empty, s=("sum", x), n=("count", x), m=("mean", x)), "s", "n", "m") == [(0, 0, None)]


def test_order(values):
    assert one(od.sort(values, "x"), "x") == [None, -5, 0, 3, 3]
    assert one(od.index(values, "x"), "index") == [1, 3, 4, 0, 2]
    assert one(od.ordinal(od.index(values, "x")), "ordinal") == [3, 0, 4, 1, 2]
    assert one(od.unique(values, "x"), "values") == [-5, 0, 3]
    assert one(od.union(values.select(ID, "x"), values.select(ID, "x")), "x") == [3, None, 3, -5, 0] * 2
    assert sorted(one(od.rnd_permutation(values, 1), "index")) == [0, 1, 2, 3, 4]


def test_natural_breaks_are_the_best():
    rng = np.random.default_rng(2)
    v = np.sort(rng.choice(60, 14, replace=False)).astype(float)
    w = rng.integers(1, 5, 14).astype(float)

    def cost(a, b):
        m = (v[a:b] * w[a:b]).sum() / w[a:b].sum()
        return (w[a:b] * (v[a:b] - m) ** 2).sum()

    best = min((cost(0, i) + cost(i, j) + cost(j, 14), v[i], v[j]) for i in range(1, 13) for j in range(i + 1, 14))
    assert br.natural_breaks(v, w, 3) == [v[0], best[1], best[2]]


def test_natural_breaks_of_many_skewed_values(spark):
    """Three groups beside a value far off, with more distinct values than any bins would hold: each is a class of its own."""
    rng = np.random.default_rng(9)
    groups = [np.unique(rng.uniform(a, a + 10, 2000)) for a in (0, 40, 100)]
    for far in (1e7, -1e7):
        values = [float(x) for x in np.concatenate([*groups, [far]])]
        got = one(br.jenks_fisher(spark.createDataFrame([(v,) for v in values], "x double"), "x", 4), "bound")
        assert got == sorted([far, *(float(g[0]) for g in groups)])


def test_natural_breaks_over_all_values_are_the_best():
    """Against the whole table of classes, without halving, over skewed values."""
    rng = np.random.default_rng(10)
    v, w = np.sort(rng.lognormal(0, 2, 300)), rng.integers(1, 5, 300).astype(float)
    s = [np.concatenate([[0.0], np.cumsum(a)]) for a in (w, w * v, w * v * v)]
    cost = np.array([[s[2][j] - s[2][i] - (s[1][j] - s[1][i]) ** 2 / (s[0][j] - s[0][i]) if i < j else np.inf for j in range(301)] for i in range(301)])
    best, begins = cost[0], []
    for _ in range(3):
        table = best[:, None] + cost
        begins.append(table.argmin(axis=0))
        best = table.min(axis=0)
    j, want = 300, []
    for begin in reversed(begins):
        j = begin[j]
        want.insert(0, v[j])
    assert br.natural_breaks(v, w, 4) == [v[0], *want]


def test_grid_distance_and_districts(spark):
    n = 9
    rng = np.random.default_rng(3)
    imp = rng.uniform(1, 5, (n, n))
    cells = spark.createDataFrame([(r * n + c, r, c, float(imp[r, c]), (r, c) in ((0, 0), (8, 3)), int(imp[r, c] > 3)) for r in range(n) for c in range(n)], "_id bigint, row int, col int, v double, s boolean, z int")
    dist = np.where([[(r, c) in ((0, 0), (8, 3)) for c in range(n)] for r in range(n)], 0.0, np.inf)
    for _ in range(n * n):
        for r in range(n):
            for c in range(n):
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        if (dr or dc) and 0 <= r + dr < n and 0 <= c + dc < n:
                            dist[r, c] = min(dist[r, c], dist[r + dr, c + dc] + (imp[r, c] + imp[r + dr, c + dc]) * (0.5 if not dr or not dc else 0.5 * math.sqrt(2)))
    got = {(r[0], r[1]): r[2] for r in gr.grid_distance(cells, "v", "s", tile=4).collect()}
    assert all(abs(got[r, c] - dist[r, c]) < 1e-9 for r in range(n) for c in range(n))


def test_networks(spark):
    nodes = spark.range(12).withColumnRenamed("id", ID)
    edges = spark.createDataFrame([(0, 5), (5, 7), (1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "f1 bigint, f2 bigint")
    parts = dict(rows(ne.connected_parts(nodes, edges), ID, "part_rel"))
    assert parts == {0: 0, 5: 0, 7: 0, 1: 1, 2: 1, 3: 1, 4: 1, 6: 2, 8: 3, 9: 4, 10: 5, 11: 6}
    strong = dict(rows(ne.strongly_connected(nodes, edges), ID, "least"))
    assert strong == {i: 1 if i in (1, 2, 3) else i for i in range(12)}
    roads = edges.withColumn("impedance", (F.col("f1") + F.col("f2")).cast("double"))
    table = {r[0]: (r[1], r[2]) for r in ne.impedance_table(nodes, roads, nodes.filter("_id = 0")).collect()}
    assert table[7] == (17.0, 5) and table[0] == (0.0, None) and table[1] == (None, None)
    matrix = rows(ne.impedance_matrix(roads, nodes.filter("_id in (0, 1)"), nodes), "origin", "destination", "impedance")
    assert (0, 7, 17.0) in matrix and (1, 4, 11.0) in matrix and len(matrix) == 7
    tree = spark.createDataFrame([(0, None, 1), (1, 0, 2), (2, 1, 3), (3, 0, 4), (4, None, 5)], "_id bigint, trace_back bigint, f int")
    assert rows(ne.service_area(tree), ID, "root") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)]
    assert rows(ne.trace_back(tree, "f"), ID, "total") == [(0, 10.0), (1, 5.0), (2, 3.0), (3, 4.0), (4, 5.0)]


def test_impedance_matrix_has_all_pairs(spark, tmp_path):
    n, rng = 40, np.random.default_rng(5)
    balance = rng.uniform(-900, 9000, n).round(2).tolist()
    spark.createDataFrame(list(enumerate(balance)), "s_suppkey bigint, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    dist = np.where(np.eye(n) > 0, 0.0, np.inf)
    for a in range(n):
        for d in (1, 7, 13):
            b = (a + d) % n
            dist[a, b] = dist[b, a] = min(dist[a, b], d + abs(balance[a]) / 1000)
    for k in range(n):
        dist = np.minimum(dist, dist[:, [k]] + dist[[k], :])
    got = {(r.origin, r.destination): r.impedance for r in qu.QUERIES["impedance_matrix"](spark, str(tmp_path)).collect()}
    assert len(got) == n * n and all(abs(x - dist[k]) < 1e-5 for k, x in got.items())


def test_geometry(spark):
    df = spark.createDataFrame([(0, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (1, [])], "_id bigint, g array<struct<x:double,y:double>>")
    g = F.col("g")
    assert one(df, ge.area(g)) == [16.0, 0.0] and one(df, ge.arc_length(g)) == [12.0, 0.0]
    assert one(df, ge.centroid(g)["x"]) == [2.0, None]
    assert rows(df.filter("_id = 0").select(ge.inside(ge.point(F.lit(1.0), F.lit(1.0)), g).alias("i"), ge.inside(ge.point(F.lit(5.0), F.lit(1.0)), g).alias("o")), "i", "o") == [(True, False)]
    assert ge.arc2segm(df, "g").count() == 3


def test_allocation(spark):
    suits = [(i, u, float((i * 7 + k * 5) % 11)) for i in range(12) for k, u in enumerate("abc")]
    df = spark.createDataFrame(suits, "_id bigint, use string, suitability double")
    out, prices = al.discrete_alloc(df, {"a": 3, "b": 12, "c": 12})
    chosen = dict(rows(out, ID, "use"))
    assert len(chosen) == 12 and sum(u == "a" for u in chosen.values()) <= 3
    value = {(i, u): s for i, u, s in suits}
    # Giving type a to no more than three cells loses least where it gains least over the second best.
    gains = sorted((max(0.0, value[i, "a"] - max(value[i, "b"], value[i, "c"])) for i in range(12)), reverse=True)
    best = sum(max(value[i, "b"], value[i, "c"]) for i in range(12)) + sum(gains[:3])
    assert abs(sum(value[i, u] for i, u in chosen.items()) - best) < 1e-4 and prices["b"] == prices["c"] == 0


def test_matrices(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 1, 4.0)], "row int, col int, value double")
    inverse = ma.matr_inv(a)
    assert rows(ma.matr_mul(a, inverse).withColumn("value", F.round("value", 9)), "row", "col", "value") == [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0)]


def test_models(spark, values):
    target = spark.createDataFrame([(0, "zero"), (1, "one")], "_id bigint, name string")
    model = mo.Model({"d": values, "t": target})
    out = model.attributes("d", a="2 + 3 * 4 ^ 2", b="x > 0 ? x * 2 : -1", c="rel->t/name + '!'", d="iif(isnull(x) || x < 0, 1, 0)", e="#t")
    assert one(out, F.col("a").cast("int")) == [50] * 5
    assert one(out, "b") == [6, -1, 6, -1, -1] and one(out, "c") == ["zero!", "zero!", "one!", None, "one!"]
    assert one(out, "d") == [0, 1, 0, 1, 0] and one(out, "e") == [2] * 5
    with pytest.raises(ValueError):
        model.attributes("d", a="2 +* 3")


def test_sources(spark, tmp_path, values):
    io.write_store(values, str(tmp_path / "store"))
    assert rows(io.read_store(spark, str(tmp_path / "store")), ID, "x") == rows(values, ID, "x")
    io.write_table(values.select(ID, "x"), str(tmp_path / "t.csv"))
    assert rows(io.read_table(spark, str(tmp_path / "t.csv"), schema="_id bigint, x int"), ID, "x") == rows(values, ID, "x")
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9\n1 2\n-9 4\n")
    assert rows(io.read_ascii_grid(spark, str(tmp_path / "g.asc")), ID, "value") == sorted([(0, 1.0), (1, 2.0), (2, None), (3, 4.0)], key=repr)
    (tmp_path / "p.xyz").write_text("1 2 3\n4,5,6\n")
    assert rows(io.read_xyz(spark, str(tmp_path / "p.xyz")), ID, "x", "z") == [(0, 1.0, 3.0), (1, 4.0, 6.0)]
