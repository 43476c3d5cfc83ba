"""Units: metrics with a factor and powers of base units, ranges, projections, and constants.

A unit says what values mean and leaves the values alone; converting multiplies them by the ratio
of two factors. Domains with a range are numbered from its lower bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import ID
from .elementwise import RANGES, STORED, cast, round_


@dataclass(frozen=True)
class Unit:
    """factor times the product of base units to their powers; scale and offset map grid places to coordinates of a base."""

    kind: str = "float64"
    factor: float = 1.0
    powers: tuple[tuple[str, int], ...] = ()
    lower: float | None = None
    upper: float | None = None
    scale: tuple[float, float] = field(default=(1.0, 1.0))
    offset: tuple[float, float] = field(default=(0.0, 0.0))
    base: str | None = None

    def __mul__(self, other: Unit | float) -> Unit:
        if not isinstance(other, Unit):
            return replace(self, factor=self.factor * other)
        return replace(self, factor=self.factor * other.factor, powers=_summed(self.powers, other.powers), lower=None, upper=None)

    __rmul__ = __mul__

    def __truediv__(self, other: Unit | float) -> Unit:
        return self * (1 / other) if not isinstance(other, Unit) else self * other**-1

    def __pow__(self, n: int) -> Unit:
        return replace(self, factor=self.factor**n, powers=_summed(tuple((b, p * n) for b, p in self.powers)), lower=None, upper=None)

    def comparable(self, other: Unit) -> bool:
        return not self.powers or not other.powers or self.powers == other.powers


def _summed(*powers: tuple[tuple[str, int], ...]) -> tuple[tuple[str, int], ...]:
    total: dict[str, int] = {}
    for base, n in (x for p in powers for x in p):
        total[base] = total.get(base, 0) + n
    return tuple(sorted((b, n) for b, n in total.items() if n))


def base_unit(name: str, kind: str = "float64") -> Unit:
    return Unit(kind, 1.0, ((name, 1),) if name else ())


def default_unit(kind: str) -> Unit:
    return Unit(kind)


def range_(unit: Unit, lower: float, upper: float) -> Unit:
    """The unit with the range lower up to upper, which isn't in it."""
    return replace(unit, lower=lower, upper=upper)


cat_range = range_


def lower_bound(unit: Unit) -> float | None:
    return unit.lower if unit.lower is not None else RANGES.get(unit.kind, (None, None))[0]


def upper_bound(unit: Unit) -> float | None:
    return unit.upper if unit.upper is not None else RANGES[unit.kind][1] + 1 if unit.kind in RANGES else None


def bound_range(unit: Unit) -> float | None:
    lo, hi = lower_bound(unit), upper_bound(unit)
    return None if lo is None or hi is None else hi - lo


def bound_center(unit: Unit) -> float | None:
    lo, hi = lower_bound(unit), upper_bound(unit)
    return None if lo is None or hi is None else (lo + hi) / 2


def domain_of(spark: SparkSession, unit: Unit) -> DataFrame:
    """The range of a unit of whole numbers as a domain: _id from the lower bound on."""
    return spark.range(int(lower_bound(unit) or 0), int(upper_bound(unit))).withColumnRenamed("id", ID)


def gridset(unit: Unit, scale: tuple[float, float], offset: tuple[float, float], base: str, lower: float | None = None, upper: float | None = None) -> Unit:
    """A grid whose place (row, col) is at offset + scale * place of the base."""
    return replace(unit, scale=scale, offset=offset, base=base, lower=lower, upper=upper)


def metric_factor(unit: Unit) -> float:
    return unit.factor


def projection_factor(unit: Unit) -> tuple[float, float]:
    return unit.scale


def projection_offset(unit: Unit) -> tuple[float, float]:
    return unit.offset


def projection_base(unit: Unit) -> str | None:
    return unit.base


def tiled(df: DataFrame, rows: int, row: str = "row", col: str = "col", cols: int | None = None) -> DataFrame:
    """A grid dealt to partitions by its tiles of rows x cols cells, which operators on tiles then find together."""
    return df.repartition(F.floor(F.col(row) / rows), F.floor(F.col(col) / (cols or rows)))


def convert(x: Column, of: Unit, to: Unit) -> Column:
    """Values of one unit as values of a comparable other: by the ratio of the factors, and into the range of its type. Undefined if they don't fit."""
    if not of.comparable(to):
        raise ValueError(f"{dict(of.powers)} and {dict(to.powers)} can't be converted")
    ratio = of.factor / to.factor
    return cast(x if ratio == 1 else x * ratio, to.kind)


def rounded_convert(x: Column, of: Unit, to: Unit) -> Column:
    """convert, to the nearest whole number, halves up, for whole types."""
    if to.kind not in RANGES:
        return convert(x, of, to)
    return convert(round_(x * (of.factor / to.factor), 64), replace(of, factor=to.factor), to)


def convert_point(p: Column, of: Unit, to: Unit) -> Column:
    """Points of one grid or base as points of another over the same base: x by the columns' scale, y by the rows'."""
    if of.base and to.base and of.base != to.base:
        raise ValueError(f"{of.base} and {to.base} are different bases")

    def there(axis: str, k: int) -> Column:
        return (((p[axis] * of.scale[k] + of.offset[k]) - to.offset[k]) / to.scale[k]).alias(axis)

    return F.struct(there("x", 1), there("y", 0))


value = convert


def of_unit(x: Column, unit: Unit) -> Column:
    """x[unit]: x in the unit's type."""
    return cast(x, unit.kind)


def const(domain: DataFrame, v: object, name: str = "const", unit: Unit | None = None) -> DataFrame:
    """The domain with the same value on each row."""
    return domain.withColumn(name, cast(F.lit(v), unit.kind) if unit else F.lit(v))


def null(kind: str) -> Column:
    """The undefined value of a type: null_b, null_u, ... by the type's name."""
    return F.lit(None).cast(STORED[kind])


def true() -> Column:
    return F.lit(True)


def false() -> Column:
    return F.lit(False)


def pi() -> Column:
    return F.lit(math.pi)


def as_data_string(df: DataFrame, x: str, order: str = ID) -> DataFrame:
    """One row: the values in the domain's order as a data block, [1,2,null]; texts in quotes. As long as the domain, so for small ones."""
    text = F.concat(F.lit("'"), F.replace(F.col(x).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) if dict(df.dtypes)[x] == "string" else F.col(x).cast("string")
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("null")).alias("v")))).alias("r"))
    return rows.select(F.concat(F.lit("["), F.array_join(F.transform("r", lambda e: e["v"]), ","), F.lit("]")).alias("data"))


def data_block(spark: SparkSession, values: Sequence[object], kind: str, name: str = "value") -> DataFrame:
    """A domain of literals: numbers, texts, None, or pairs as points (x, y)."""
    stored = "struct<x:double,y:double>" if kind == "point" else STORED[kind]
    rows = [(i, (float(v[0]), float(v[1])) if kind == "point" and v is not None else v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{ID} bigint, {name} {stored}")
