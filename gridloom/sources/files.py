"""Shapefiles, TIFF and BMP rasters, dBASE and ASCII grids: read from whole files as they lie in a store, written file by file.

Files are read through the session's own file systems (binaryFile), one task a file, and written
through them too. A raster comes as cells: file, _id, row, col, value.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import ID, with_ordinal
from ..operators.polygon import RINGS

CELLS = f"file string, {ID} long, row int, col int, value double"
#: Rows of a raster that a batch has.
STRIP = 1 << 18


def _files(spark: SparkSession, path: str, read: Callable[[bytes], Iterator[dict[str, object]]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for columns in read(raw.as_py()):
                    n = len(next(iter(columns.values())))
                    yield pa.RecordBatch.from_pydict({"file": [name] * n} | columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """A file of a store that the session can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(raw)
    finally:
        out.close()


# Shapefiles: geometries as rings, points as one ring of one point.


def _shapes(raw: bytes) -> Iterator[dict[str, object]]:
    at, ids, kinds, out = 100, [], [], []
    while at + 8 <= len(raw):
        number, words = struct.unpack(">ii", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        flat = kind % 10  # with heights or measures: their x and y
        if kind == 0:
            rings = None
        elif flat == 1:
            rings = [[dict(zip("xy", struct.unpack("<2d", body[4:20]), strict=True))]]
        elif flat == 8:
            n = struct.unpack("<i", body[36:40])[0]
            points = np.frombuffer(body, "<f8", 2 * n, 40).reshape(-1, 2).tolist()
            rings = [[{"x": x, "y": y} for x, y in points]]
        else:
            parts, n = struct.unpack("<2i", body[36:44])
            first = [*np.frombuffer(body, "<i4", parts, 44).tolist(), n]
            points = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2).tolist()
            rings = [[{"x": x, "y": y} for x, y in points[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
        ids.append(number - 1)
        kinds.append(flat)
        out.append(rings)
    yield {ID: pa.array(ids, pa.int64()), "kind": pa.array(kinds, pa.int32()), "geometry": pa.array(out, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))}


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """file, _id, kind (1 point, 3 lines, 5 polygon, 8 points), geometry as rings; a null shape is undefined."""
    return _files(spark, path, _shapes, f"file string, {ID} long, kind int, geometry {RINGS}")


def write_shp(df: DataFrame, path: str, geometry: str, kind: int = 5) -> None:
    """One shapefile and its index, of lines (3), polygons (5) or points (1), in the domain's order. The format holds 2 GB at most, and the driver writes it."""
    body, index, box, at = [], [], [np.inf, np.inf, -np.inf, -np.inf], 50
    for k, (rings,) in enumerate(df.orderBy(ID).select(geometry).toLocalIterator()):
        points = [np.array([(p["x"], p["y"]) for p in ring]) for ring in rings or ()]
        if kind == 5:
            points = [np.concatenate([p, p[:1]]) if (p[0] != p[-1]).any() else p for p in points]
        if not points:
            record = struct.pack("<i", 0)
        elif kind == 1:
            record = struct.pack("<i2d", 1, *points[0][0])
        else:
            every = np.concatenate(points)
            first = np.cumsum([0, *(len(p) for p in points[:-1])])
            record = struct.pack("<i4d2i", kind, *every.min(axis=0), *every.max(axis=0), len(points), len(every)) + first.astype("<i4").tobytes() + every.astype("<f8").tobytes()
        if points:
            every = np.concatenate(points)
            box = [*np.minimum(box[:2], every.min(axis=0)), *np.maximum(box[2:], every.max(axis=0))]
        index.append(struct.pack(">2i", at, len(record) // 2))
        body.append(struct.pack(">2i", k + 1, len(record) // 2) + record)
        at += (len(record) + 8) // 2
    box = [0.0] * 4 if box[0] == np.inf else box
    head = lambda words: struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)
    stem = path.removesuffix(".shp")
    write_bytes(df.sparkSession, f"{stem}.shp", head(at) + b"".join(body))
    write_bytes(df.sparkSession, f"{stem}.shx", head(50 + 4 * len(index)) + b"".join(index))


# TIFF: strips or tiles of one sample a cell, plain, deflated or packed.

# TIFF's tags and types.
WIDTH, HEIGHT, BITS, PACKING, OFFSETS, ROWS, COUNTS, TILE_W, TILE_H, TILES, TILE_COUNTS, SAMPLE, SAMPLES, PREDICTOR, NODATA = 256, 257, 258, 259, 273, 278, 279, 322, 323, 324, 325, 339, 277, 317, 42113
SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8), 12: ("d", 8), 11: ("f", 4)}


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = "<" if raw[:2] == b"II" else ">"
    at, out = struct.unpack(f"{order}I", raw[4:8])[0], {}
    for k in range(struct.unpack(f"{order}H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(f"{order}HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in SIZES:
            continue
        code, size = SIZES[kind]
        place = at + 10 + 12 * k if n * size <= 4 else struct.unpack(f"{order}I", raw[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        found = raw[place : place + n * size]
        out[tag] = (found.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{n}{code}", found)
    return order, out


def _unpacked_bits(raw: bytes) -> bytes:
    """PackBits: a count and that many bytes, or one byte to be repeated."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def _tif(raw: bytes) -> Iterator[dict[str, object]]:
    order, tags = _tags(raw)
    first = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, bits, packing = first(WIDTH), first(HEIGHT), first(BITS, 1), first(PACKING, 1)
    if first(SAMPLES, 1) != 1 or bits not in (8, 16, 32, 64) or packing not in (1, 8, 32946, 32773) or first(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"a TIFF of {first(SAMPLES, 1)} samples of {bits} bits, packed by {packing}")
    kind = np.dtype(f"{order}{'uif'[first(SAMPLE, 1) - 1]}{bits // 8}")
    none = float(first(NODATA)) if NODATA in tags and str(first(NODATA)).strip() else None
    tiled = TILES in tags
    bw, bh = (first(TILE_W), first(TILE_H)) if tiled else (w, first(ROWS, h))
    across = -(-w // bw)
    for k, (at, n) in enumerate(zip(tags[TILES if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True)):
        block = raw[at : at + n]
        block = zlib.decompress(block) if packing in (8, 32946) else _unpacked_bits(block) if packing == 32773 else block
        r0, c0 = k // across * bh, k % across * bw
        rows, cols = min(bh, h - r0), min(bw, w - c0)
        cells = np.frombuffer(block, kind)[: (bh if tiled else rows) * bw].reshape(-1, bw)
        if first(PREDICTOR, 1) == 2:
            cells = np.cumsum(cells, axis=1, dtype=kind)
        cells = cells[:rows, :cols].astype(np.float64)
        row, col = np.divmod(np.arange(rows * cols), cols)
        row, col, value = row + r0, col + c0, cells.ravel()
        empty = np.isnan(value) | (value == none if none is not None else False)
        for lo in range(0, len(value), STRIP):
            s = slice(lo, lo + STRIP)
            yield {ID: pa.array(row[s] * w + col[s], pa.int64()), "row": pa.array(row[s], pa.int32()), "col": pa.array(col[s], pa.int32()), "value": pa.array(value[s], mask=empty[s])}


def read_tif(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, _tif, CELLS)


def _dense(df: DataFrame, value: str, fill: float) -> np.ndarray:
    """A raster that goes to one file: as large as that file, on the driver."""
    cells = df.select("row", "col", F.col(value).cast("double")).toPandas().to_numpy(float)
    out = np.full((int(cells[:, 0].max()) + 1, int(cells[:, 1].max()) + 1) if len(cells) else (0, 0), fill)
    out[cells[:, 0].astype(int), cells[:, 1].astype(int)] = np.where(np.isnan(cells[:, 2]), fill, cells[:, 2])
    return out


def write_tif(df: DataFrame, path: str, value: str = "value", kind: str = "f8", nodata: float = -9999.0, rows: int = 64) -> None:
    """One deflated TIFF of strips; kind: f4, f8, u1, u2, u4, i1, i2 or i4."""
    cells = _dense(df, value, nodata).astype(f"<{kind}")
    h, w = cells.shape
    strips = [zlib.compress(cells[r : r + rows].tobytes()) for r in range(0, h, rows)]
    text = f"{nodata:g}\0".encode()
    starts = [int(x) for x in 8 + np.cumsum([0, *map(len, strips)])]
    tags = {WIDTH: ("I", [w]), HEIGHT: ("I", [h]), BITS: ("H", [8 * int(kind[1])]), PACKING: ("H", [8]), 262: ("H", [1]), OFFSETS: ("I", starts[:-1]), SAMPLES: ("H", [1]), ROWS: ("I", [rows]), COUNTS: ("I", [len(s) for s in strips]), SAMPLE: ("H", ["uif".index(kind[0]) + 1]), NODATA: ("s", text)}
    head = starts[-1] + starts[-1] % 2
    after = head + 2 + 12 * len(tags) + 4
    entries, extra = b"", b""
    for tag in sorted(tags):
        code, values = tags[tag]
        raw, n = (values, len(values)) if code == "s" else (struct.pack(f"<{len(values)}{code}", *values), len(values))
        if len(raw) <= 4:
            place = raw.ljust(4, b"\0")
        else:
            place, extra = struct.pack("<I", after + len(extra)), extra + raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, {"I": 4, "H": 3, "s": 2}[code], n) + place
    raw = b"II*\0" + struct.pack("<I", head) + b"".join(strips) + b"\0" * (starts[-1] % 2) + struct.pack("<H", len(tags)) + entries + bytes(4) + extra
    write_bytes(df.sparkSession, path, raw)


def _bmp(raw: bytes) -> Iterator[dict[str, object]]:
    start, head, w, h, bits, packing = struct.unpack("<I", raw[10:14])[0], *struct.unpack("<Iii", raw[14:26]), *struct.unpack("<HI", raw[28:34])
    if bits not in (8, 24) or packing:
        raise ValueError(f"a BMP of {bits} bits, packed by {packing}")
    stride, down = -(-w * bits // 32) * 4, h < 0
    rows = np.frombuffer(raw, np.uint8, stride * abs(h), start).reshape(-1, stride)[:, : w * bits // 8]
    rows = rows if down else rows[::-1]
    value = rows.astype(np.float64) if bits == 8 else rows.reshape(abs(h), w, 3).astype(np.int64) @ np.array([65536, 256, 1])
    row, col = np.divmod(np.arange(value.size), w)
    yield {ID: pa.array(np.arange(value.size), pa.int64()), "row": pa.array(row, pa.int32()), "col": pa.array(col, pa.int32()), "value": pa.array(value.ravel().astype(np.float64))}


def read_bmp(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a bitmap: places in its palette, or colours as numbers of red + 256 green + 65536 blue."""
    return _files(spark, path, _bmp, CELLS)


def read_palette(spark: SparkSession, path: str) -> DataFrame:
    """The palette of a bitmap: file, _id, rgb as red + 256 green + 65536 blue."""

    def colours(raw: bytes) -> Iterator[dict[str, object]]:
        head, used = struct.unpack("<I", raw[14:18])[0], struct.unpack("<I", raw[46:50])[0] or 256
        entries = np.frombuffer(raw, np.uint8, 4 * used, 14 + head).reshape(-1, 4).astype(np.int64)
        yield {ID: pa.array(range(used), pa.int64()), "rgb": pa.array(entries[:, 2] + 256 * entries[:, 1] + 65536 * entries[:, 0], pa.int32())}

    return _files(spark, path, colours, f"file string, {ID} long, rgb int")


def write_bmp(df: DataFrame, path: str, value: str = "value", palette: Sequence[int] = ()) -> None:
    """A bitmap of places in a palette, given as numbers of red + 256 green + 65536 blue; without one a ramp of greys."""
    cells = _dense(df, value, 0).astype(np.uint8)
    h, w = cells.shape
    colours = np.array([*palette] or [k * 0x010101 for k in range(256)], np.int64)
    table = np.stack([colours >> 16, (colours >> 8) & 255, colours & 255, colours * 0], axis=1).astype(np.uint8).tobytes()
    lines = np.pad(cells[::-1], ((0, 0), (0, -w % 4))).tobytes()
    start = 54 + len(table)
    head = b"BM" + struct.pack("<IHHI", start + len(lines), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, len(lines), 2835, 2835, len(colours), 0)
    write_bytes(df.sparkSession, path, head + table + lines)


def write_ascii_grid(df: DataFrame, path: str, value: str = "value", corner: tuple[float, float] = (0.0, 0.0), size: float = 1.0, nodata: float = -9999.0) -> None:
    cells = _dense(df, value, nodata)
    head = f"ncols {cells.shape[1]}\nnrows {cells.shape[0]}\nxllcorner {corner[0]:g}\nyllcorner {corner[1]:g}\ncellsize {size:g}\nNODATA_value {nodata:g}\n"
    write_bytes(df.sparkSession, path, (head + "".join(" ".join(f"{v!r}" for v in row) + "\n" for row in cells.tolist())).encode())


def write_dbf(df: DataFrame, path: str, order: str = ID) -> None:
    """Texts, numbers and logical values of a domain as a dBASE file, in its order; the driver writes it row by row."""
    columns = [(c, t) for c, t in df.dtypes if c != order]
    longest = df.agg(*[F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(1)).alias(c) for c, _ in columns]).first() if columns else []
    fields = [(c, "L" if t == "boolean" else "C" if t in ("string", "date") else "N", 1 if t == "boolean" else min(254, max(1, n)), 15 if t in ("double", "float") else 0) for (c, t), n in zip(columns, longest, strict=True)]
    fields = [(c, k, 24 if d else n, d) for c, k, n, d in fields]
    rows, count = [], 0
    for r in df.orderBy(order).select(*[c for c, _ in columns]).toLocalIterator():
        parts = []
        for v, (_, kind, n, decimals) in zip(r, fields, strict=True):
            text = "" if v is None else "T" if v is True else "F" if v is False else f"{v:.{decimals}g}" if kind == "N" and decimals else str(v)
            raw = text.encode("latin-1", "replace")[:n]
            parts.append(raw.rjust(n) if kind == "N" else raw.ljust(n))
        rows.append(b" " + b"".join(parts))
        count += 1
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, count, 32 + 32 * len(fields) + 1, size)
    head += b"".join(c.encode("latin-1", "replace")[:10].ljust(11, b"\0") + k.encode() + bytes(4) + bytes([n, 0 if k != "N" else min(d, n - 1)]) + bytes(14) for c, k, n, d in fields) + b"\r"
    write_bytes(df.sparkSession, path, head + b"".join(rows) + b"\x1a")


def write_strings(df: DataFrame, folder: str, name: str, text: str) -> None:
    """Each row's text as a file of its own, by its name; tasks write their rows' files through the folder's file system."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        files.create_dir(at, recursive=True)
        for batch in batches:
            for n, t in zip(batch["n"], batch["t"], strict=True):
                with files.open_output_stream(f"{at}/{n}") as out:
                    out.write((t or "").encode())
            yield pd.DataFrame({"n": batch["n"]})

    df.select(F.col(name).cast("string").alias("n"), F.col(text).alias("t")).mapInPandas(run, "n string").write.format("noop").mode("overwrite").save()


def read_e00(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an exported coverage's ARC section: file, _id (its number), from_node, to_node, geometry."""

    def arcs(raw: bytes) -> Iterator[dict[str, object]]:
        lines = iter(raw.decode("latin-1").splitlines())
        ids, starts, ends, out = [], [], [], []
        for line in lines:
            if not line.startswith("ARC "):
                continue
            wide = line.split()[1] == "3"
            for head in lines:
                values = [int(head[k : k + 10]) for k in range(0, 70, 10)]
                if values[0] < 0:
                    break
                flat: list[float] = []
                while len(flat) < 2 * values[6]:
                    line, width = next(lines), 21 if wide else 14
                    flat += [float(line[k : k + width]) for k in range(0, len(line.rstrip()), width)]
                ids.append(values[0])
                starts.append(values[2])
                ends.append(values[3])
                out.append([{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2], strict=True)])
        yield {ID: pa.array(ids, pa.int64()), "from_node": pa.array(starts, pa.int64()), "to_node": pa.array(ends, pa.int64()), "geometry": pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))}

    return _files(spark, path, arcs, f"file string, {ID} long, from_node long, to_node long, geometry array<struct<x:double,y:double>>")


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON file: _id, the properties (a schema) and geometry as rings; lines and points are one ring."""
    kind = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select(F.input_file_name().alias("_f"), F.posexplode("features").alias("_k", "f"))
    nested = "array<" * 4 + "double" + ">" * 4
    text = F.col("f.geometry.coordinates")
    deep = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
    filled = F.coalesce(*[F.when(F.col("f.geometry.type") == k, F.concat(F.lit("[" * (4 - n)), text, F.lit("]" * (4 - n)))) for k, n in deep.items()])
    rings = F.transform(F.flatten(F.from_json(filled, nested)), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return with_ordinal(rows.select("_f", "_k", "f.properties.*", rings.alias("geometry")), ["_f", "_k"]).drop("_f", "_k")


# Files themselves, in any store of the session.


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def existing_file(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return bool(files.exists(at))


def make_dir(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return bool(files.mkdirs(at))


def copy_file(spark: SparkSession, source: str, to: str) -> bool:
    (a, one), (b, two) = _at(spark, source), _at(spark, to)
    return bool(spark._jvm.org.apache.hadoop.fs.FileUtil.copy(one, a, two, b, False, spark._jsc.hadoopConfiguration()))


def init_file(spark: SparkSession, path: str, raw: bytes = b"") -> bool:
    """A file with that beginning, if there is none; whether it was made."""
    if existing_file(spark, path):
        return False
    write_bytes(spark, path, raw)
    return True


def full_path_name(spark: SparkSession, path: str) -> str:
    at, files = _at(spark, path)
    return files.makeQualified(at).toString()


def current_dir(spark: SparkSession) -> str:
    _, files = _at(spark, ".")
    return files.getWorkingDirectory().toString()
