"""Models: named domains, and attributes given as expressions that are compiled to columns.

Expressions have, from loose to tight: ?:, or ||, and &&, not !, comparisons, + -, * / %, ^, and
calls, numbers, quoted texts, names, rel->domain/attribute and #domain. An attribute of one domain
is a column of its table, so that all attributes of a domain are one projection to the optimizer; a
followed relation is a left join, made once for each relation and domain.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import ID, with_ordinal
from ..functions import elementwise as el
from ..functions import strings as st
from ..operators import aggregate as ag

TOKEN = re.compile(r"\s*(?:(\d+\.\d*(?:[eE][-+]?\d+)?|\d+)|'((?:[^']|'')*)'|([A-Za-z_][A-Za-z_0-9]*)|(->|\|\||&&|==|!=|<>|<=|>=|[-+*/%^()?:,!<>=#\[\]]))")

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "sqrt": el.sqrt, "exp": el.exp, "log": el.log, "sqr": el.sqr, "abs": F.abs, "neg": lambda x: -x, "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan, "round": el.round_, "roundup": el.round_up, "rounddown": el.round_down,
    "roundtozero": el.round_to_zero, "isnull": el.is_null, "isdefined": el.is_defined, "ispositive": el.is_positive, "isnegative": el.is_negative, "iszero": el.is_zero, "makedefined": el.make_defined, "iif": el.iif, "min_elem": el.min_elem,
    "max_elem": el.max_elem, "argmin": el.argmin, "argmax": el.argmax, "median": el.median, "plogp": el.plogp, "add_or_null": el.add_or_null, "sub_or_null": el.sub_or_null, "mul_or_null": el.mul_or_null, "concat": st.concat, "strlen": st.strlen,
    "uppercase": F.upper, "lowercase": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "quote": st.quote, "unquote": st.unquote, "ashex": st.as_hex, "asitemname": st.as_item_name, "urldecode": st.url_decode, "rgb": el.rgb,
    "eq": el.eq, "ne": el.ne, "lt": el.lt, "le": el.le, "gt": el.gt, "ge": el.ge, "add": el.add, "sub": el.sub, "mul": el.mul, "div": el.div, "mod": el.mod, "not": lambda x: ~x, "and": lambda a, b: a & b, "or": lambda a, b: a | b,
    **{kind: (lambda x, k=kind: el.cast(x, k)) for kind in el.STORED},
}
LEVELS = (("||", "or"), ("&&", "and"))
COMPARE = {"==": el.eq, "=": el.eq, "!=": el.ne, "<>": el.ne, "<": el.lt, "<=": el.le, ">": el.gt, ">=": el.ge}


class Parser:
    """A recursive descent over one expression, to a column of the domain's table."""

    def __init__(self, text: str, column: Callable[[str], Column], follow: Callable[[str, str, str], Column], size: Callable[[str], Column]):
        self.tokens, self.at, self.column, self.follow, self.size = [], 0, column, follow, size
        place = 0
        while place < len(text.rstrip()):
            found = TOKEN.match(text, place)
            if not found:
                raise ValueError(f"can't read {text[place:]!r} of {text!r}")
            self.tokens.append(next((kind, x) for kind, x in zip(("number", "text", "name", "sign"), found.groups(), strict=True) if x is not None))
            place = found.end()

    def peek(self) -> str | None:
        return self.tokens[self.at][1].lower() if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") else None

    def take(self, *signs: str) -> str | None:
        if (sign := self.peek()) in signs:
            self.at += 1
            return sign
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"{sign!r} is missing at token {self.at}")

    def parse(self) -> Column:
        out = self.choice()
        if self.at < len(self.tokens):
            raise ValueError(f"{self.tokens[self.at][1]!r} is left over")
        return out

    def choice(self) -> Column:
        cond = self.either(0)
        if self.take("?"):
            yes = self.choice()
            self.need(":")
            return el.iif(cond, yes, self.choice())
        return cond

    def either(self, level: int) -> Column:
        if level == len(LEVELS):
            return self.negated()
        out = self.either(level + 1)
        while self.take(*LEVELS[level]):
            right = self.either(level + 1)
            out = out & right if level else out | right
        return out

    def negated(self) -> Column:
        return ~self.negated() if self.take("!", "not") else self.compared()

    def compared(self) -> Column:
        out = self.summed()
        sign = self.take(*COMPARE)
        return COMPARE[sign](out, self.summed()) if sign else out

    def summed(self) -> Column:
        out = self.product()
        while sign := self.take("+", "-"):
            right = self.product()
            # A column answers to any name with a field, so what is marked is looked up in its own dictionary.
            is_text = vars(out).get("_is_text", False) or vars(right).get("_is_text", False)
            out = F.concat(out, right) if is_text and sign == "+" else out + right if sign == "+" else out - right
            out._is_text = is_text
        return out

    def product(self) -> Column:
        out = self.raised()
        while sign := self.take("*", "/", "%"):
            out = {"*": el.mul, "/": el.div, "%": el.mod}[sign](out, self.raised())
        return out

    def raised(self) -> Column:
        out = self.signed()
        if not self.take("^"):
            return out
        kind, x = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "number" and x.isdigit():  # small whole powers are products
            self.at += 1
            return el.power(out, int(x))
        return el.power(out, self.raised())

    def signed(self) -> Column:
        if self.take("-"):
            return -self.signed()
        if self.take("#"):
            return self.size(self.word())
        return self.atom()

    def word(self) -> str:
        kind, x = self.tokens[self.at]
        if kind != "name":
            raise ValueError(f"{x!r} is no name")
        self.at += 1
        return x

    def atom(self) -> Column:
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        kind, x = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(x) if re.search(r"[.eE]", x) else int(x))
        if kind == "text":
            out = F.lit(x.replace("''", "'"))
            out._is_text = True
            return out
        if kind != "name":
            raise ValueError(f"{x!r} is out of place")
        if self.take("("):
            args = []
            while not self.take(")"):
                args.append(self.choice())
                self.take(",")
            if x.lower() not in FUNCTIONS:
                raise ValueError(f"there is no function {x}")
            return FUNCTIONS[x.lower()](*args)
        if self.take("->"):
            domain = self.word()
            self.need("/")
            out = self.follow(x, domain, self.word())
            return out
        if x.lower() in ("true", "false"):
            return F.lit(x.lower() == "true")
        return self.column(x)


class Model:
    """Named domains; attributes and aggregates as expressions over them."""

    def __init__(self, domains: Mapping[str, DataFrame]):
        self.domains = dict(domains)

    def attributes(self, domain: str, **rules: str) -> DataFrame:
        """The domain with an attribute for each rule; rules see the domain's own attributes."""
        df, joined, columns = self.domains[domain], {}, []

        def typed(name: str, kinds: dict[str, str]) -> Column:
            out = F.col(name)
            out._is_text = kinds.get(name) == "string"
            return out

        def follow(rel: str, to: str, attribute: str) -> Column:
            there = self.domains[to]
            name = f"_{rel}_{to}_{attribute}"
            joined.setdefault((rel, to), {})[attribute] = name
            out = F.col(name)
            out._is_text = dict(there.dtypes)[attribute] == "string"
            return out

        kinds = dict(df.dtypes)
        for name, rule in rules.items():
            columns.append(Parser(rule, lambda c: typed(c, kinds), follow, lambda d: F.lit(self.domains[d].count())).parse().alias(name))
        for (rel, to), wanted in joined.items():
            there = self.domains[to].select(F.col(ID).alias("_to"), *[F.col(a).alias(n) for a, n in wanted.items()])
            df = df.join(there, df[rel] == F.col("_to"), "left").drop("_to")
        return df.select("*", *columns)

    def aggregates(self, target: str, domain: str, rel: str, **rules: str) -> DataFrame:
        """On the target, name='aggregate(expression)' over the rows of a domain that refer to it."""
        wanted, inner = {}, {}
        for name, rule in rules.items():
            found = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", rule, re.S)
            if not found or found[1] not in ag.SIMPLE:
                raise ValueError(f"{rule!r} is no aggregate")
            inner[f"_{name}"] = found[2]
            wanted[name] = (found[1], F.col(f"_{name}"))
        return ag.along(self.attributes(domain, **inner), rel, self.domains[target], **wanted)


def for_each(names: Mapping[str, object], rule: str) -> dict[str, str]:
    """A rule for each name, with what stands for it in the braces."""
    return {name: rule.format(value) for name, value in names.items()}


def loop(template: Callable[[DataFrame, int], DataFrame], start: DataFrame, n: int, every: int = 4) -> DataFrame:
    """Applies a template n times; the plan is cut every few steps."""
    from ..core import cut

    out = start
    for i in range(n):
        out = template(out, i)
        if i % every == every - 1:
            out = cut(out)
    return out


def read_lines(domain: DataFrame, text: str) -> DataFrame:
    """org_rel, ordinal, geometry: the lines of each text."""
    return domain.select(F.col(ID).alias("org_rel"), F.posexplode(F.split(text, "\r?\n")).alias("ordinal", "geometry"))


def split_piped_string(domain: DataFrame, text: str) -> DataFrame:
    """A domain of the parts between bars: org_rel and geometry."""
    parts = domain.select(F.col(ID).alias("org_rel"), F.posexplode(F.split(text, "\\|")).alias("ordinal", "geometry"))
    return with_ordinal(parts, ["org_rel", "ordinal"])
