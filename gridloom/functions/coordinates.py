"""Coordinates of the Dutch national grid and geographic ones, by published polynomials; and the Mandelbrot set's counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grid's origin on the ground and on the ellipsoid, and the polynomials' coefficients by the powers (of the first, of the second variable).
ORIGIN, GEOGRAPHIC = (155000.0, 463000.0), (5.387638889, 52.156160556)
LATITUDE = {
    (0, 1): 3236.0331637, (2, 0): -32.5915821, (0, 2): -0.2472814, (2, 1): -0.8501341, (0, 3): -0.0655238, (2, 2): -0.0171137,
    (4, 0): 0.0052771, (2, 3): -0.0003859, (4, 1): 0.0003314, (0, 4): 0.0000371, (4, 2): 0.0000143, (2, 4): -0.0000090,
}
LONGITUDE = {
    (1, 0): 5261.3028966, (1, 1): 105.9780241, (1, 2): 2.4576469, (3, 0): -0.8192156, (3, 1): -0.0560092, (1, 3): 0.0560089,
    (3, 2): -0.0025614, (1, 4): 0.0012770, (5, 0): 0.0002574, (3, 3): -0.0000973, (5, 1): 0.0000293, (1, 5): 0.0000291,
}
#: What is added to either, in units of 1e-5 degrees: alone, by degrees of latitude over 52, by degrees of longitude over 5.
ED50 = ((89.120, 3.708, -17.176), (-18.00, -14.723, -1.029))
WGS84 = ((-37.902, 0.329, -14.667), (-96.862, -11.714, -0.125))
#: A shift and a turn of the grid that one map service needs.
GE = ((17.78369991, -0.0000749081, -0.0000128123), (40.18290427, -0.0000064425, -0.0000846220))
#: Back: the origin, and the coefficients by the powers (of latitude, of longitude).
BACK_ORIGIN, BACK_SCALE = (5.38720621, 52.15517440), 0.36
EAST = {(0, 1): 190094.945, (1, 1): -11832.228, (2, 1): -144.221, (0, 3): -32.391, (1, 0): -0.705, (3, 1): -2.340, (1, 3): -0.608, (0, 2): -0.008, (2, 3): 0.148}
NORTH = {(1, 0): 309056.544, (0, 2): 3638.893, (2, 0): 73.077, (1, 2): -157.984, (3, 0): 59.788, (0, 1): 0.433, (2, 2): -6.439, (1, 1): -0.032, (0, 4): 0.092, (1, 4): -0.054}


def _polynomial(terms: Mapping[tuple[int, int], float], a: Column, b: Column) -> Column:
    """The sum of the terms; powers as products, which keep their last digits."""

    def power(x: Column, n: int) -> Column:
        out = F.lit(1.0)
        for _ in range(n):
            out = out * x
        return out

    out = F.lit(0.0)
    for (i, j), k in terms.items():
        out = out + F.lit(k) * power(a, i) * power(b, j)
    return out


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def rd2latlong(p: Column) -> Column:
    """Longitude x and latitude y on the grid's own ellipsoid, in degrees; an error outside of the grid."""
    inside = p["x"].between(0, 290000) & p["y"].between(290000, 630000)
    dx, dy = (p["x"] - ORIGIN[0]) / 100000, (p["y"] - ORIGIN[1]) / 100000
    found = _point(GEOGRAPHIC[0] + _polynomial(LONGITUDE, dx, dy) / 3600, GEOGRAPHIC[1] + _polynomial(LATITUDE, dx, dy) / 3600)
    return F.when(p.isNull(), F.lit(None)).when(inside, found).otherwise(F.raise_error(F.lit("a place outside of the grid")).cast("struct<x:double,y:double>"))


def _moved(p: Column, by: tuple) -> Column:
    step = lambda k: (by[k][0] + by[k][1] * (p["y"] - 52) + by[k][2] * (p["x"] - 5)) / 100000
    return _point(p["x"] + step(0), p["y"] + step(1))


def rd2latlong_ed50(p: Column) -> Column:
    return _moved(rd2latlong(p), ED50)


def rd2latlong_wgs84(p: Column) -> Column:
    return _moved(rd2latlong(p), WGS84)


def rd2latlong_ge(p: Column) -> Column:
    turned = [p[axis] + GE[k][0] + GE[k][1] * p["x"] + GE[k][2] * p["y"] for k, axis in enumerate("xy")]
    return rd2latlong_wgs84(_point(*turned))


def latlong_wgs84_2rd(p: Column) -> Column:
    dl, df = BACK_SCALE * (p["x"] - BACK_ORIGIN[0]), BACK_SCALE * (p["y"] - BACK_ORIGIN[1])
    return _point(ORIGIN[0] + _polynomial(EAST, df, dl), ORIGIN[1] + _polynomial(NORTH, df, dl))


def mandelbrot(x: Column, y: Column, most: int) -> Column:
    """How many times z = z * z + place stays within two of nothing, `most` at most."""
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).alias("n"))
    step = lambda z, _: F.when(z["x"] * z["x"] + z["y"] * z["y"] > 4, z).otherwise(F.struct((z["x"] * z["x"] - z["y"] * z["y"] + x).alias("x"), (2 * z["x"] * z["y"] + y).alias("y"), (z["n"] + 1).alias("n")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda z: z["n"])
