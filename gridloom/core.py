"""What every operator shares: domains as tables with an ordinal, and safe cuts of lineage.

A domain is a DataFrame with the column `_id`, 0 .. n-1 in the domain's order. An attribute is a
column of it; a relation is a column that holds another domain's `_id`.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID = "_id"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's spark.checkpoint.dir, or what was set on its context.

    A local session without either gets a temporary one, as in tests; a cluster's executors would
    not see it, so there it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if at := spark.conf.get("spark.checkpoint.dir", None):
            context.setCheckpointDir(at)
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        else:
            raise RuntimeError("spark.checkpoint.dir is not set: it names a folder that the driver and all executors share")
    return context.getCheckpointDir()


def _path(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


#: The folder of each table that cut wrote.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage.

    What is read back has its real size, so plans over it can be sized; a checkpoint would keep the
    estimate of the plan that it cut, which grows with every join of a loop. The tables `done`,
    which came from here and are read no more, are removed; the rest goes when the session ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    df.write.parquet(folder)
    discard(*done)
    out = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


def discard(*done: DataFrame) -> None:
    """Removes tables that cut wrote, once nothing reads them any more."""
    for df in done:
        if folder := _FOLDERS.pop(df, None):
            path, files = _path(df.sparkSession, folder)
            files.delete(path, True)


def swept(df: DataFrame) -> DataFrame:
    """df, behind whose cut nothing of the shuffles is left: their files go once the driver's garbage is collected, which else happens by chance.

    The scheduler holds on to the job that ran last until it has another, so it gets one of a row.
    """
    spark = df.sparkSession
    spark.range(1).collect()
    spark._jvm.System.gc()
    return df


def offsets(rows: DataFrame, part: Column) -> DataFrame:
    """(_part, _offset): the number of rows in the parts before each. One row a partition, on the driver and in a broadcast."""
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    before = itertools.accumulate([0, *(r["n"] for r in sizes)])
    return rows.sparkSession.createDataFrame([(int(r["_part"]), n) for r, n in zip(sizes, before, strict=False)], "_part long, _offset long")


def with_ordinal(df: DataFrame, order: Sequence[str | Column], name: str = ID) -> DataFrame:
    """Numbers the rows 0 .. n-1 by an order, without a window over all of them.

    Rows are range-partitioned and sorted; a partition's rows are numbered from the count of rows
    before it. The table of offsets has one row a partition. Sorting puts nulls first.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(rows)
    part = F.shiftright("_at", 33).cast("long")
    out = rows.withColumn("_part", part).join(F.broadcast(offsets(rows, part)), "_part")
    return out.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_offset")


def renumbered(df: DataFrame, keep: str | None = None) -> DataFrame:
    """A subset of a domain as a domain of its own, in the same order; keep names the old ordinal."""
    old = keep or "_old"
    out = with_ordinal(df.withColumnRenamed(ID, old), [old])
    return out if keep else out.drop(old)


def dense(domain: DataFrame, grouped: DataFrame, key: str, fill: dict[str, object] | None = None) -> DataFrame:
    """The results of groups on all of a domain: empty groups get the fill, or null."""
    out = domain.select(ID).join(grouped.withColumnRenamed(key, ID), ID, "left")
    return out.fillna(fill) if fill else out
