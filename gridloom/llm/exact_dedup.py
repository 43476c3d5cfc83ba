"""Exact duplicates of texts, found in three steps that never gather a group.

Every step groups by the text itself as well as by its digest, so texts are compared in full and
a digest that two texts share could not merge them:

1. local: each task merges the copies among its own rows (the map side of the first grouping);
2. salted: the tasks' winners meet by (salt, digest, text), so that a text which a third of all
   rows share is spread over as many reducers as there are salts;
3. global: the salts' winners meet by (digest, text); at most one row for each salt and text.

A row then finds its group by digest, second hash and length, and takes it only if the group's text,
which groups of several rows carry along, is its own. That join reads one row a document on one side
and one row a distinct text on the other, both from exchanges of their own, so that adaptive
execution can split the partitions of a hot text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, swept, text_of

SALTS = 16


def normalised(column: str | Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(text_of(column), SPACES, " ")


def sha256(column: Column) -> Column:
    return F.unhex(F.sha2(column, 256))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row a distinct normalised text: digest, second hash, length, keep_id, group_size, and the text where the group has several rows."""
    text = normalised(text_col)
    rows = df.select(F.col(id_col).alias("id"), (F.spark_partition_id() % salts).alias("salt"), text.alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = rows.groupBy("salt", "digest", "norm").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "norm").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("group_size"))
    return merged.select("digest", F.xxhash64("norm").alias("second"), F.length("norm").alias("long"), "keep_id", "group_size", F.when(F.col("group_size") > 1, F.col("norm")).alias("same"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical once each run of white space is one space. The smallest id of
    equal texts stays. A null text counts as empty; empty texts equal each other. Repeated rows
    count in group_size and share the verdict of their id. A null id never wins over another; a
    group of nothing but null ids keeps them. An empty table gives an empty result. Other columns
    of df are not read, whatever their names.
    """
    found = swept(cut(groups(df, id_col, text_col, salts, digest)))
    rows = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    sha = F.sha2("norm", 256) if digest is not sha256 else F.lit(None).cast("string")
    rows = rows.select("id", digest(F.col("norm")).alias("digest"), F.xxhash64("norm").alias("second"), F.length("norm").alias("long"), "norm", sha.alias("sha"))
    # A row alone in its group has that group's id; others have its text.
    own = F.when(F.col("same").isNull(), F.col("id").eqNullSafe(F.col("keep_id"))).otherwise(F.col("norm") == F.col("same"))
    out = rows.join(found, ["digest", "second", "long"]).filter(own)
    sha = F.col("sha") if digest is not sha256 else F.lower(F.hex("digest"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of df that stay, with all of their columns: one a distinct text.

    The row travels beside its normalised text, which costs little: the shuffle's compression finds
    the one in the other. Of rows that repeat the smallest id, the least by the other columns stays.
    A null id never wins over another, a null text counts as empty, and an empty table gives an
    empty result.
    """
    others = [c for c in df.columns if c != id_col]
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = df.select((F.spark_partition_id() % salts).alias("salt"), normalised(text_col).alias("norm"), row.alias("row")).withColumn("digest", sha256(F.col("norm")))
    salted = rows.groupBy("salt", "digest", "norm").agg(F.min("row").alias("row"))
    merged = salted.groupBy("digest", "norm").agg(F.min("row").alias("row"))
    place = {id_col: "id"} | {c: f"c{i}" for i, c in enumerate(others)}
    return merged.select(*[F.col(f"row.{place[c]}").alias(c) for c in df.columns])
