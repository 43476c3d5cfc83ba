"""Reading and writing of domains: tables, texts, point lists, ASCII grids, dBASE files, XML, stores of columns."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import ID, with_ordinal

TABLES = {"parquet": "parquet", "csv": "csv", "json": "json", "geojson": "json", "orc": "orc", "txt": "text"}


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None, **options: object) -> DataFrame:
    """A table by the ending of its path, or a named kind; csv files have a header."""
    kind = TABLES[kind or path.rstrip("/").rpartition(".")[2]]
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def read_query(spark: SparkSession, url: str, query: str, **options: object) -> DataFrame:
    """What a database answers to a query, through JDBC."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_table(df: DataFrame, path: str, kind: str | None = None, **options: object) -> None:
    kind = TABLES[kind or path.rstrip("/").rpartition(".")[2]]
    df.write.mode("overwrite").options(**({"header": True} if kind == "csv" else {}) | options).format(kind).save(path)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """Each file of a path as one text: file, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Lines of three numbers: x, y, z, in order of file and line; other lines have undefined ones."""
    parts = F.split(F.trim("value"), r"[\s,;]+")
    rows = spark.read.text(path).select(*[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("xyz")], F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_n"))
    return with_ordinal(rows, ["_f", "_n"]).drop("_f", "_n")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """An ASCII grid with its header: _id, row, col, value; the header's mark for no data is undefined."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0).alias("lines"))
    head = lambda name, default=None: F.coalesce(F.get(F.filter(F.transform("lines", lambda x: F.regexp_extract(x, rf"(?i)^\s*{name}\s+(\S+)", 1)), lambda x: x != ""), F.lit(0)).try_cast("double"), F.lit(default))
    body = F.filter("lines", lambda x: ~x.rlike(r"(?i)^\s*[a-z]"))
    rows = lines.select(head("ncols").cast("int").alias("_w"), head("nodata_value", -9999.0).alias("_none"), F.posexplode(body).alias("row", "_line"))
    cells = rows.select("row", "_w", "_none", F.posexplode(F.split(F.trim("_line"), r"\s+")).alias("col", "_v"))
    value = F.col("_v").try_cast("double")
    return cells.select((F.col("row").cast("bigint") * F.col("_w") + F.col("col")).alias(ID), "row", "col", F.when(value != F.col("_none"), value).alias("value"))


DBF = {"C": "string", "N": "double", "F": "double", "L": "boolean", "D": "string"}


def _dbf_fields(raw: bytes) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    count, head, size = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while raw[at] != 0x0D:
        name = raw[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(raw[at + 11]), raw[at + 16]))
        at += 32
    return count, head, size, fields


def read_dbf(spark: SparkSession, path: str) -> DataFrame:
    """A dBASE file, or several of one layout; records marked as deleted are left out."""
    files = spark.read.format("binaryFile").load(path)
    _, _, _, fields = _dbf_fields(files.select("content").first()[0])
    kinds = ", ".join(f"`{name}` {DBF[kind]}" for name, kind, _ in fields)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                count, head, size, fields = _dbf_fields(raw)
                rows = []
                for i in range(count):
                    record, at, row = raw[head + i * size : head + (i + 1) * size], 1, []
                    for _, kind, width in fields:
                        text = record[at : at + width].decode("latin-1").strip()
                        at += width
                        row.append(None if text == "" else float(text) if kind in "NF" else text in "YyTt" if kind == "L" else text)
                    if record[:1] != b"*":
                        rows.append(row)
                yield pd.DataFrame(rows, columns=[f[0] for f in fields])

    return files.select("content").mapInPandas(parse, kinds)


def parse_xml(df: DataFrame, text: str, schema: str, name: str = "parsed") -> DataFrame:
    """The text of a column as XML of a schema; what doesn't parse is undefined."""
    return df.withColumn(name, F.from_xml(F.col(text), F.lit(schema), {"mode": "PERMISSIVE"}))


def write_store(df: DataFrame, path: str) -> None:
    """A domain as Parquet, with a dictionary of its attributes beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    words = df.sparkSession.createDataFrame([(json.dumps(json.loads(df.schema.json())),)], "value string")
    words.coalesce(1).write.mode("overwrite").text(f"{path}/dictionary")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/dictionary").first()[0]))
    return spark.read.schema(schema).parquet(f"{path}/data")
