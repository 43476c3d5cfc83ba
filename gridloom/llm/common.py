"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import cut, discard, shared_folder, swept

__all__ = ["cut", "discard", "shared_folder", "swept"]

# The white space of the contracts, as Java and RE2 classes.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(column, UPPER, UPPER.lower())


def words_of(column: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(column, SPACES), lambda w: w != "")


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what the operators deal their work out to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
