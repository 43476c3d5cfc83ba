"""Arithmetic, comparison, rounding and choice with the engine's rules for undefined values.

Comparisons are two-valued: false where a side is undefined. Division by zero, logarithms of what
isn't positive, roots of negatives and overflow of exp are undefined. Integer division truncates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest value of the narrow types; unsigned ones keep their greatest pattern for undefined.
RANGES = {
    "uint2": (0, 3), "uint4": (0, 15), "uint8": (0, 254), "uint16": (0, 65534), "uint32": (0, 2**32 - 2), "int8": (-127, 127), "int16": (-32767, 32767),
    "int32": (-(2**31) + 1, 2**31 - 1), "int64": (-(2**63) + 1, 2**63 - 1),
}
STORED = {"uint2": "tinyint", "uint4": "tinyint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "bool": "boolean", "string": "string"}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def eq(a: Column, b: Column) -> Column:
    return _sure(a == b)


def ne(a: Column, b: Column) -> Column:
    return _sure(a != b)


def lt(a: Column, b: Column) -> Column:
    return _sure(a < b)


def le(a: Column, b: Column) -> Column:
    return _sure(a <= b)


def gt(a: Column, b: Column) -> Column:
    return _sure(a > b)


def ge(a: Column, b: Column) -> Column:
    return _sure(a >= b)


def compared(op: str, a: Column, b: Column, null: str) -> Column:
    """Comparison that also holds if `both`, the `lhs` or the `rhs` is undefined."""
    base = {"eq": eq, "ne": ne, "lt": lt, "le": le, "gt": gt, "ge": ge}[op](a, b)
    return base | {"both": a.isNull() & b.isNull(), "lhs": a.isNull(), "rhs": b.isNull(), "one": a.isNull() != b.isNull()}[null]


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def add_or_null(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def sub_or_null(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def mul_or_null(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def div(a: Column, b: Column) -> Column:
    """Division of real numbers."""
    return F.when(b != 0, a / b)


def idiv(a: Column, b: Column) -> Column:
    """Division of whole numbers, towards zero."""
    return F.when(b != 0, F.call_function("div", a, b))


def mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % b)


def power(x: Column, n: int | float | Column) -> Column:
    """Small whole powers as products; others as exp(n * log(x)), undefined unless x is positive."""
    if isinstance(n, int) and 2 <= n <= 6:
        out = x
        for _ in range(n - 1):
            out = out * x
        return out
    return F.when(x > 0, F.exp(F.lit(n) * F.ln(x) if not isinstance(n, Column) else n * F.ln(x)))


def iif(c: Column, a: Column, b: Column) -> Column:
    return F.when(_sure(c), a).otherwise(b)


def switch(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    out = otherwise
    for c, v in reversed(cases):
        out = iif(c, v, out)
    return out


def exp(x: Column) -> Column:
    return F.when(x <= 709.78, F.exp(x))


def log(x: Column, base: float | None = None) -> Column:
    out = F.when(x > 0, F.ln(x))
    return out if base is None else out / math.log(base)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def sqr(x: Column) -> Column:
    return x * x


def plogp(x: Column) -> Column:
    return F.coalesce(x * log(x), F.lit(0.0))


def _clamped(x: Column, bits: int) -> Column:
    top = 2.0 ** (bits - 1)
    return F.greatest(F.lit(-top), F.least(F.lit(top - (1 if bits == 32 else 1024)), x)).cast("int" if bits == 32 else "bigint")


def round_(x: Column, bits: int = 32) -> Column:
    """The nearest whole number, halves up, held to the range of the result."""
    return _clamped(F.floor(x + 0.5).cast("double"), bits)


def round_up(x: Column, bits: int = 32) -> Column:
    return _clamped(F.ceil(x).cast("double"), bits)


def round_down(x: Column, bits: int = 32) -> Column:
    return _clamped(F.floor(x).cast("double"), bits)


def round_to_zero(x: Column, bits: int = 32) -> Column:
    return _clamped(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), bits)


def is_null(x: Column) -> Column:
    return x.isNull()


def is_defined(x: Column) -> Column:
    return x.isNotNull()


def is_positive(x: Column) -> Column:
    return _sure(x > 0)


def is_negative(x: Column) -> Column:
    return _sure(x < 0)


def is_zero(x: Column) -> Column:
    return _sure(x == 0)


def make_defined(*x: Column) -> Column:
    return F.coalesce(*x)


def replace_value(x: Column, *pairs: tuple[Column, Column]) -> Column:
    out = x
    for old, new in pairs:
        out = F.when(_sure(out == old), new).otherwise(out)
    return out


def min_elem(*x: Column, defined: str = "if") -> Column:
    """The least argument; defined='if' skips undefined ones, 'all' wants every one defined."""
    return F.least(*x) if defined == "if" else F.when(_all_defined(*x), F.least(*x))


def max_elem(*x: Column, defined: str = "if") -> Column:
    return F.greatest(*x) if defined == "if" else F.when(_all_defined(*x), F.greatest(*x))


def _all_defined(*x: Column) -> Column:
    out = x[0].isNotNull()
    for c in x[1:]:
        out = out & c.isNotNull()
    return out


def argmin(*x: Column, defined: str = "if") -> Column:
    """Place of the least argument, the first of equals."""
    return (F.array_position(F.array(*x), min_elem(*x, defined=defined)) - 1).cast("int")


def argmax(*x: Column, defined: str = "if") -> Column:
    return (F.array_position(F.array(*x), max_elem(*x, defined=defined)) - 1).cast("int")


def median(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def is_overlapping(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    return le(a1, b2) & le(a2, b1)


def neighbourhood(x: Column, value: Column, distance: Column) -> Column:
    return ge(x, value - distance) & le(x, value + distance)


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(b.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + r.cast("int")


def cast(x: Column, kind: str) -> Column:
    """To a type of RANGES or STORED; what doesn't fit is undefined, and so is NaN."""
    if kind in RANGES:
        lo, hi = RANGES[kind]
        whole = x.try_cast("decimal(38,10)")
        whole = F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole))
        return F.when(whole.between(lo, hi), whole).cast(STORED[kind])
    if kind == "uint64":
        return F.when(x >= 0, x.try_cast("decimal(20,0)"))
    out = x.try_cast(STORED[kind])
    return F.when(~F.isnan(out), out) if kind.startswith("float") else out


def ramp(first: float, last: float, n: int, ordinal: Column, open_: bool = False) -> Column:
    size = n if open_ else max(n - 1, 1)
    return first * (size - ordinal) / size + last * ordinal / size


def ll1(x: Column) -> Column:
    """The logistic function."""
    return 1 / (1 + F.exp(-x))
