"""Scripts: trees of items made by rules, templates, repetition and indirection, and what can be told of them.

An item is a domain, an attribute's rule, a value, or a container of items. Rules are expressions of
a model; a template is a function that makes a container of its arguments. Everything is a plan
until it is collected.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import ID, cut
from .model import FUNCTIONS, Model, Parser


class Container(dict):
    """Named items in their order, with properties of their own; a path's parts are parted by slashes."""

    def __init__(self, items: Mapping[str, Any] | None = None, **props: str):
        super().__init__(items or {})
        self.props = props

    def item(self, path: str) -> Any:
        """SubItem(container, 'name')."""
        out: Any = self
        for name in path.strip("/").split("/"):
            if not isinstance(out, Container) or name not in out:
                raise KeyError(f"{path!r} has no item {name!r}")
            out = out[name]
        return out

    def put(self, path: str, value: Any) -> Container:
        """The container with an item at a path, whose containers are made if need be."""
        at, (*way, name) = self, path.strip("/").split("/")
        for step in way:
            at = at.setdefault(step, Container())
        at[name] = value
        return self

    def tree(self, under: str = "") -> Iterator[tuple[str, Any]]:
        """All items below with their paths, from the top down."""
        for name, value in self.items():
            yield f"{under}/{name}", value
            if isinstance(value, Container):
                yield from value.tree(f"{under}/{name}")


def container(*items: tuple[str, Any], **props: str) -> Container:
    return Container(dict(items), **props)


class Rule:
    """An expression over a domain, with properties; its value is planned when it is asked for."""

    def __init__(self, domain: str, expr: str, **props: str):
        self.domain, self.expr, self.props = domain, expr, {"Expr": expr} | props


def evaluated(model: Model, rule: Rule, name: str = "value") -> DataFrame:
    """(_id, name) of a rule. A rule that begins with = is a text that is evaluated for the rule proper: of constants alone."""
    expr = rule.expr
    while expr.lstrip().startswith("="):
        expr = constant(expr.lstrip()[1:], next(iter(model.domains.values())).sparkSession)
    return model.attributes(rule.domain, **{name: expr}).select(ID, name)


def constant(expr: str, spark: SparkSession) -> Any:
    """The value of an expression without names."""

    def unknown(name: str) -> Any:
        raise ValueError(f"{name!r} isn't constant")

    column = Parser(expr, unknown, lambda rel, to, attribute: unknown(rel), unknown).parse()
    return spark.range(1).select(column).first()[0]


def scope(model: Model, items: Container, rule: Rule, name: str = "value") -> DataFrame:
    """A rule that sees the domains of a container before the model's own."""
    own = {k: v for k, v in items.items() if isinstance(v, DataFrame)}
    return evaluated(Model({**model.domains, **own}), rule, name)


Template = Callable[..., Container]


def instantiate(templates: Mapping[str, Template], call: str, *args: Any) -> Container:
    """A template call by name: a tree of its own, made of the arguments; a name that is a function of expressions is none."""
    if call.lower() in FUNCTIONS:
        raise ValueError(f"{call} is a function, no template")
    if call not in templates:
        raise KeyError(f"there is no template {call}")
    out = templates[call](*args)
    out.props.setdefault("template", call)
    return out


# The letters of a repetition's name, and what each says of an argument, in their order.
ROLES = {"n": "name", "e": "expr", "i": "inherit", "t": "template", "d": "domain", "v": "values", "c": "container", "p": "parameter", "x": "index", "l": "label", "a": "storage", "s": "sql"}


def roles(name: str) -> list[str]:
    """Of for_each_ne and the like: what each argument is."""
    if not (found := re.fullmatch(r"for_each_([a-z]+)", name)):
        raise ValueError(f"{name} is no repetition")
    letters = found[1]
    if not letters.startswith("n") or set(letters) - set(ROLES):
        raise ValueError(f"{name}: a repetition begins with names and has the letters {''.join(ROLES)}")
    return [ROLES[x] for x in letters]


def for_each(name: str, *args: Any) -> Container:
    """for_each_n...: an item for each name. Each letter after for_each_ says what an argument is, one value for all names or one a name.

    With e the items are rules over the domain d, with t they are instances of a template, else
    containers; the rest are properties of the item.
    """
    wanted = roles(name)
    if len(args) != len(wanted):
        raise ValueError(f"{name} has {len(wanted)} arguments: {', '.join(wanted)}")
    given = dict(zip(wanted, args, strict=True))
    names = list(given.pop("name"))
    if len(set(names)) < len(names):
        raise ValueError(f"{name}: names are given twice")
    one_each = lambda v, i: v[i] if isinstance(v, Sequence) and not isinstance(v, str) else v
    out = Container()
    for i, item in enumerate(names):
        mine = {k: one_each(v, i) for k, v in given.items()}
        props = {k: str(v) for k, v in mine.items() if k in ("label", "storage", "sql", "values", "parameter")}
        if "template" in mine:
            made = mine["template"](item, *[mine[k] for k in ("domain", "expr") if k in mine])
            made.props.update(props)
            out[item] = made
        elif "expr" in mine:
            out[item] = Rule(mine.get("domain", ""), mine["expr"], **props)
        else:
            out[item] = Container(**props)
    return out


def for_each_ind(spec: str, names: Sequence[str], *args: Any) -> Container:
    """for_each with the letters as a text."""
    return for_each(f"for_each_{spec}" if spec.startswith("n") else f"for_each_n{spec}", names, *args)


def iterate(names: Sequence[str], step: Callable[[DataFrame, str], DataFrame], start: DataFrame, every: int = 4) -> Container:
    """A chain of items, each made of the one before and its name; the plan is cut every few steps."""
    out, now = Container(), start
    for i, name in enumerate(names):
        now = step(now, name)
        if i % every == every - 1:
            now = cut(now)
        out[name] = now
    return out


def phase(items: Container, say: Callable[[str], None] = lambda text: None, message: str = "") -> Container:
    """PhaseContainer: every table below is done and written before what follows is planned."""
    out = Container(items, **items.props)
    for name, value in items.items():
        out[name] = phase(value, say) if isinstance(value, Container) else cut(value) if isinstance(value, DataFrame) else value
    if message:
        say(message)
    return out


def _kind(value: Any) -> str:
    return "unit" if isinstance(value, DataFrame) else "attribute" if isinstance(value, Rule) else "container" if isinstance(value, Container) else "parameter"


def prop_value(item: Any, name: str, own: str = "") -> str | None:
    """A property of an item: its own, or what can be told of any."""
    props = getattr(item, "props", {}) if not isinstance(item, DataFrame) else {}
    told = {"name": own, "kind": _kind(item), "Expr": props.get("Expr", "" if isinstance(item, (DataFrame, Container, Rule)) else repr(item))}
    return props.get(name, told.get(name))


def sub_item_props(spark: SparkSession, items: Container, name: str) -> DataFrame:
    """(_id, name, value): a property of each item right below."""
    return _frame(spark, [(k, prop_value(v, name, k)) for k, v in items.items()])


def sub_tree_props(spark: SparkSession, items: Container, name: str) -> DataFrame:
    """The same of all items below, by path."""
    return _frame(spark, [(path, prop_value(v, name, path.rpartition("/")[2])) for path, v in items.tree()])


def inherited_prop(items: Container, path: str, name: str) -> str | None:
    """A property of an item, or of the nearest container above that has it."""
    way, found, at = path.strip("/").split("/"), items.props.get(name), items
    for step in way:
        at = at[step]
        found = getattr(at, "props", {}).get(name, found) if not isinstance(at, DataFrame) else found
    return found


def _frame(spark: SparkSession, rows: list[tuple[str, str | None]]) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ID} bigint, name string, value string")


def generate(model: Model, items: Container) -> Container:
    """A container's rules as tables: one projection a domain, so that all its rules are one plan."""
    rules = {path: v for path, v in items.tree() if isinstance(v, Rule)}
    out = Container()
    for domain, some in itertools.groupby(sorted(rules.items(), key=lambda x: x[1].domain), key=lambda x: x[1].domain):
        named = {f"a{i}": (path, rule.expr) for i, (path, rule) in enumerate(some)}
        df = model.attributes(domain, **{a: expr for a, (_, expr) in named.items()})
        for a, (path, _) in named.items():
            out.put(path, df.select(ID, F.col(a).alias(path.rpartition("/")[2])))
    return out


def doc_data(spark: SparkSession) -> DataFrame:
    """(_id, name, value) of the functions that expressions have, with what they say of themselves."""
    return _frame(spark, [(name, (f.__doc__ or "").split("\n")[0] if hasattr(f, "__doc__") else "") for name, f in sorted(FUNCTIONS.items())])


def doc_storage_managers(spark: SparkSession) -> DataFrame:
    """(_id, name, value) of the readers and writers of files."""
    from ..sources import files, io

    rows = [(name, (f.__doc__ or "").split("\n")[0]) for module in (io, files) for name, f in vars(module).items() if name.startswith(("read_", "write_")) and callable(f)]
    return _frame(spark, sorted(rows))


def version(spark: SparkSession) -> str:
    return f"spark {spark.version}"


def explain(model: Model, rule: Rule, row: int) -> DataFrame:
    """(_id, name, value): where one row's value comes from: the rule, its result there, and each name that the rule has with its value there.

    Only that row is planned, and the rows it refers to.
    """
    domain = model.domains[rule.domain]
    spark = domain.sparkSession
    one = Model({**model.domains, rule.domain: domain.filter(F.col(ID) == row)})
    names = list(dict.fromkeys(re.findall(r"[A-Za-z_]\w*(?:\s*->\s*\w+\s*/\s*\w+)?", re.sub(r"'(?:[^']|'')*'", "", rule.expr))))
    known = [n for n in names if "->" in n or n in domain.columns]
    found = one.attributes(rule.domain, _result=rule.expr, **{f"_n{i}": n for i, n in enumerate(known)}).first()
    told = [("rule", rule.expr)]
    if found is not None:
        told += [("result", _text(found["_result"])), *[(n, _text(found[f"_n{i}"])) for i, n in enumerate(known)]]
    return _frame(spark, told)


def _text(value: object) -> str | None:
    return None if value is None else str(value)


def expand(text: str, **values: object) -> str:
    """A text with %name% replaced by the values; unknown names stay."""
    return re.sub(r"%(\w+)%", lambda m: str(values.get(m[1], m[0])), text)
