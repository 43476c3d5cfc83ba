"""Sorting, ranking, distinct values, unions and random numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ID, with_ordinal


def sort(domain: DataFrame, x: str) -> DataFrame:
    """The values in order, undefined ones first."""
    return with_ordinal(domain.select(x), [x])


def index(domain: DataFrame, *keys: str) -> DataFrame:
    """The permutation that sorts the domain by the keys, stable: _id is the rank, index the row."""
    return with_ordinal(domain.select(F.col(ID).alias("index"), *keys), [*keys, "index"]).select(ID, "index")


def ordinal(permutation: DataFrame, rel: str = "index") -> DataFrame:
    """The inverse of a permutation: each row's rank."""
    return permutation.select(F.col(rel).alias(ID), F.col(ID).alias("ordinal"))


def unique(domain: DataFrame, x: str, with_null: bool = False) -> DataFrame:
    """A domain of the distinct values in order."""
    values = domain.select(F.col(x).alias("values"))
    values = values if with_null else values.filter("values IS NOT NULL")
    return with_ordinal(values.distinct(), ["values"])


def union(*domains: DataFrame) -> DataFrame:
    """All rows of the domains, one after the other."""
    parts = [d.withColumn("_part", F.lit(i)) for i, d in enumerate(domains)]
    return with_ordinal(reduce(lambda a, b: a.unionByName(b), parts).withColumnRenamed(ID, "_old"), ["_part", "_old"]).drop("_part", "_old")


def intersect(a: DataFrame, b: DataFrame, x: str) -> DataFrame:
    """The distinct values of both."""
    return with_ordinal(a.select(F.col(x).alias("values")).intersect(b.select(F.col(x).alias("values"))), ["values"])


def subtract(a: DataFrame, b: DataFrame, x: str) -> DataFrame:
    """The distinct values of the first that the second doesn't have."""
    return with_ordinal(a.select(F.col(x).alias("values")).subtract(b.select(F.col(x).alias("values"))), ["values"])


def rnd_uniform(domain: DataFrame, seed: int, name: str = "rnd") -> DataFrame:
    """A number in [0, 1) for each row, by its ordinal and the seed alone."""
    return domain.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), ID), F.lit(1 << 53)) / float(1 << 53))


def rnd_permutation(domain: DataFrame, seed: int) -> DataFrame:
    return with_ordinal(domain.select(F.col(ID).alias("index"), F.xxhash64(F.lit(seed), ID).alias("_r")), ["_r", "index"]).select(ID, "index")
