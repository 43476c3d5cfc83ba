"""Sub-domains: selections, and moving attributes into and out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import ID, renumbered


def select(domain: DataFrame, cond: Column) -> DataFrame:
    """The rows that meet a condition, in order, numbered anew, with all attributes; undefined counts as unmet."""
    return renumbered(domain.filter(cond))


def select_with_org_rel(domain: DataFrame, cond: Column) -> DataFrame:
    """As select, with the relation org_rel to the source domain."""
    return renumbered(domain.filter(cond), keep="org_rel")


def collect_by_cond(domain: DataFrame, cond: Column, *data: str) -> DataFrame:
    return renumbered(domain.filter(cond).select(ID, *data))


def collect_by_org_rel(selection: DataFrame, domain: DataFrame, *data: str) -> DataFrame:
    """Attributes of the source domain on a selection of it."""
    return selection.select(ID, "org_rel").join(domain.select(F.col(ID).alias("org_rel"), *data), "org_rel", "left").select(ID, *data)


def recollect_by_cond(domain: DataFrame, selection: DataFrame, data: str, fallback: Column | None = None) -> DataFrame:
    """A selection's attribute back on the source domain; elsewhere the fallback, or undefined."""
    back = selection.select(F.col("org_rel").alias(ID), F.col(data).alias("_v"), F.lit(True).alias("_in"))
    value = F.when(F.col("_in"), F.col("_v"))
    if fallback is not None:
        value = F.when(F.col("_in"), F.col("_v")).otherwise(fallback)
    return domain.join(back, ID, "left").select(ID, value.alias(data))


def integrity_check(domain: DataFrame, cond: Column, message: str = "integrity check failed") -> DataFrame:
    """The domain as it is; reading it fails at the first row that doesn't meet the condition."""
    fail = F.raise_error(F.lit(message)).cast("boolean")
    return domain.filter(F.when(F.coalesce(cond, F.lit(False)), F.lit(True)).otherwise(fail))
