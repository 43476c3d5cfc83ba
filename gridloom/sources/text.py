"""Values read out of texts: by place, by number, and out of XML."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import ID, with_ordinal
from ..functions.elementwise import cast

BETWEEN = r"[\s,;]+"


def read_elems(df: DataFrame, text: str, place: str | int, kind: str, name: str = "value", after: str | None = None) -> DataFrame:
    """The one value that begins at a place of each row's text, and, if `after` is named, the place behind it."""
    at = F.col(place) if isinstance(place, str) else F.lit(place)
    rest = F.substring(F.col(text), at + 1, F.length(text))
    lead = F.length(F.regexp_extract(rest, r"^[\s,;]*", 0))
    quoted = F.regexp_extract(rest, r"^[\s,;]*(?:\"([^\"]*)\"|'([^']*)')", 1)
    word = F.regexp_extract(rest, r"^[\s,;]*(\"[^\"]*\"|'[^']*'|[^\s,;]+)", 1)
    bare = F.when(word.rlike("^[\"']"), F.substring(word, F.lit(2), F.length(word) - 2)).otherwise(F.nullif(word, F.lit("")))
    out = df.withColumn(name, cast(F.nullif(bare, F.lit("null")), kind) if kind != "string" else F.when(quoted != "", quoted).otherwise(bare))
    return out.withColumn(after, at + lead + F.length(word)) if after else out


def read_array(df: DataFrame, text: str, n: Column | str, kind: str, place: int = 0) -> DataFrame:
    """org_rel, ordinal and value: of each row's text the first n values from a place on, undefined where there are fewer; read_pos is the place behind the last."""
    rest = F.substring(F.col(text), F.lit(place + 1), F.length(text))
    words = F.filter(F.split(rest, BETWEEN), lambda w: w != "")
    size = F.col(n) if isinstance(n, str) else n
    parts = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(words, i))
    used = F.lit(place) + F.length(F.regexp_extract(rest, r"^[\s,;]*", 0)) + F.coalesce(F.length(F.array_join(F.slice(words, F.lit(1), size), " ")), F.lit(0))
    rows = df.filter(size > 0).select(F.col(ID).alias("org_rel"), used.alias("read_pos"), F.posexplode(parts).alias("ordinal", "_w"))
    return rows.select("org_rel", "ordinal", cast(F.nullif(F.col("_w"), F.lit("null")), kind).alias("value"), "read_pos")


def read_value(df: DataFrame, text: str, kind: str, place: int = 0) -> DataFrame:
    """read_array of one value."""
    return read_array(df, text, F.lit(1), kind, place)


def split_multi(df: DataFrame, sequence: str) -> DataFrame:
    """org_rel and geometry: the stretches of a sequence between its undefined elements, empty ones left out, as a domain. Elements are rows between, so that a stretch costs its own length."""
    each = df.select(F.col(ID).alias("org_rel"), F.posexplode(sequence).alias("_i", "_e"))
    each = each.withColumn("_k", F.count(F.when(F.col("_e").isNull(), 1)).over(Window.partitionBy("org_rel").orderBy("_i")))
    rows = each.filter("_e IS NOT NULL").groupBy("org_rel", "_k").agg(F.sort_array(F.collect_list(F.struct("_i", "_e"))).alias("_s"))
    return with_ordinal(rows.select("org_rel", "_k", F.transform("_s", lambda s: s["_e"]).alias("geometry")), ["org_rel", "_k"]).drop("_k")


split_multi_linestring = split_multi
split_multi_numberstring = split_multi


def xml_tables(df: DataFrame, text: str, template: Mapping[str, Mapping[str, str]], root: str) -> dict[str, DataFrame]:
    """Entity tables out of XML texts. template: entity -> its values' types; an entity named parent/child is within that parent.

    Each table has _id, parent_rel (of the text, or of the parent entity's row) and the values;
    entities that a text lacks have no rows. What doesn't parse gives none.
    """

    def schema(entity: str) -> str:
        inside = [f"`{k}`:{v}" for k, v in template[entity].items()]
        inside += [f"`{e.rpartition('/')[2]}`:array<{schema(e)}>" for e in template if e.rpartition("/")[0] == entity]
        return f"struct<{','.join(inside)}>"

    top = [e for e in template if "/" not in e]
    kind = ", ".join(f"`{e}` array<{schema(e)}>" for e in top)
    parsed = df.select(F.col(ID).alias("_text"), F.from_xml(F.col(text), F.lit(kind), {"mode": "PERMISSIVE", "rowTag": root}).alias("_x"))
    out: dict[str, DataFrame] = {}

    def shred(rows: DataFrame, entity: str, value: Column) -> None:
        each = with_ordinal(rows.select(F.col("_up").alias("parent_rel"), F.posexplode(value).alias("_k", "_e")), ["parent_rel", "_k"])
        out[entity] = each.select(ID, "parent_rel", *[F.col(f"_e.{v}").alias(v) for v in template[entity]])
        for child in (e for e in template if e.rpartition("/")[0] == entity):
            shred(each.select(F.col(ID).alias("_up"), "_e"), child, F.col("_e")[child.rpartition("/")[2]])

    for e in top:
        shred(parsed.select(F.col("_text").alias("_up"), "_x"), e, F.col("_x")[e])
    return out
