"""Matrices as cells (row, col, value): products by an equi-join, inverses by one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 4096


def matr_mul(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("row", F.col("col").alias("_k"), F.col("value").alias("_a"))
    right = b.select(F.col("row").alias("_k"), "col", F.col("value").alias("_b"))
    return left.join(right, "_k").groupBy("row", "col").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def matr_var(a: DataFrame) -> DataFrame:
    """The products of the columns with one another."""
    turned = a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return matr_mul(turned, a)


def matr_inv(a: DataFrame, most: int = MOST) -> DataFrame:
    """The inverse of a square matrix of `most` rows at most, which is checked."""
    n = (a.agg(F.max(F.greatest("row", "col"))).first()[0] or 0) + 1
    if n > most:
        raise ValueError(f"{n} rows; {most} at most can be inverted")
    dense = np.zeros((n, n))
    for r, c, v in a.select("row", "col", "value").collect():
        dense[r, c] = v
    found = np.linalg.inv(dense)
    return a.sparkSession.createDataFrame([(i, j, float(found[i, j])) for i in range(n) for j in range(n)], "row int, col int, value double")
