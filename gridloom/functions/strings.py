"""Text functions. Places count from zero; strlen counts bytes; what isn't found is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    """Undefined parts count as empty; a + b of two texts is F.concat, which is undefined if a part is."""
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def substr(s: Column, pos: int, size: int | None = None) -> Column:
    return F.substring(s, F.lit(pos + 1), F.lit(size) if size is not None else F.length(s))


def left(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def repeat(s: Column, n: int) -> Column:
    return F.repeat(s, n)


def strpos(s: Column, part: str) -> Column:
    return F.nullif(F.instr(s, F.lit(part)), F.lit(0)) - 1


def strrpos(s: Column, part: str) -> Column:
    found = F.nullif(F.instr(F.reverse(s), F.lit(part[::-1])), F.lit(0))
    return F.length(s) - found + 1 - len(part)


def strcount(s: Column, part: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def strlen(s: Column) -> Column:
    return F.octet_length(s)


def replace(s: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def quote(s: Column, mark: str = "'") -> Column:
    return F.concat(F.lit(mark), F.replace(s, F.lit(mark), F.lit(mark * 2)), F.lit(mark))


def unquote(s: Column, mark: str = "'") -> Column:
    """A text within marks without them, doubled marks single; other texts as they are."""
    inner = F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit(mark * 2), F.lit(mark))
    return F.when(s.startswith(mark) & s.endswith(mark) & (F.length(s) > 1), inner).otherwise(s)


def as_hex(s: Column) -> Column:
    return F.hex(F.encode(s, "UTF-8"))


def as_item_name(s: Column) -> Column:
    """Letters, digits and underscores; an underscore before a leading digit."""
    return F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_]", "_"), "^([0-9])", "_$1")


def url_decode(s: Column) -> Column:
    return F.try_url_decode(s)


def regex_search(s: Column, pattern: str) -> Column:
    """The first match, or undefined."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 0))


def regex_match(s: Column, pattern: str) -> Column:
    return F.coalesce(s.rlike(f"^(?:{pattern})$"), F.lit(False))


def regex_replace(s: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(s, pattern, by)
