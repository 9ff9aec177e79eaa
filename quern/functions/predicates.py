"""Predicates over an entity's columns, with the precedence and null semantics of SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DefinitionError, StoreError
from .filters import all_of
from .values import fitting, literal

if TYPE_CHECKING:
    from ..sources.entity import Entity

#: Values of a list up to which membership is part of the predicate; longer lists are joined, by broadcast up to a size.
LIST_JOIN, LIST_BROADCAST = 1000, 1_000_000
_JSON_PATH = re.compile(r"\$(\.[A-Za-z_][A-Za-z0-9_]*)+\Z")


class Compare(Enum):
    """Comparisons and how many arguments each takes."""

    EQUAL = ("=", 1)
    NOT_EQUAL = ("<>", 1)
    GREATER = (">", 1)
    GREATER_OR_EQUAL = (">=", 1)
    LESS = ("<", 1)
    LESS_OR_EQUAL = ("<=", 1)
    BETWEEN = ("between", 2)
    NOT_BETWEEN = ("not between", 2)
    IS_NULL = ("is null", 0)
    IS_NOT_NULL = ("is not null", 0)
    LIKE = ("like", 1)
    NOT_LIKE = ("not like", 1)
    IN = ("in", 1)
    NOT_IN = ("not in", 1)

    @property
    def arguments(self) -> int:
        return self.value[1]


@dataclass(frozen=True)
class Where:
    """One criterion; ``or_`` starts a new group. Groups are joined by OR, criteria within a group by AND, as SQL reads them."""

    field: str
    compare: Compare = Compare.EQUAL
    or_: bool = False
    json_path: str | None = None


@dataclass
class Membership:
    """A long list, to be joined: the marker column is true where ``column`` is one of ``values``."""

    marker: str
    column: SparkColumn
    kind: str
    values: list
    stored: Callable[[SparkColumn], SparkColumn] | None = None


def check(entity: type[Entity], criteria: tuple[Where, ...]) -> int:
    """Raise if a criterion cannot apply to ``entity``; the number of arguments they take together."""
    for w in criteria:
        c = entity.column(w.field)
        if w.json_path is not None and not _JSON_PATH.match(w.json_path):
            raise DefinitionError("json-path-syntax", f"{w.json_path} is not a dotted path such as $.a.b")
        if w.json_path is not None and c.spark_type != "string":
            raise DefinitionError("json-path-on-no-text", f"{c.name} is no text, so it has no JSON path")
        if w.compare in (Compare.LIKE, Compare.NOT_LIKE) and c.spark_type != "string":
            raise DefinitionError("pattern-on-no-text", f"{c.name} is no text, so it cannot be compared with a pattern")
    return sum(w.compare.arguments for w in criteria)


def condition(entity: type[Entity], criteria: tuple[Where, ...], arguments: tuple) -> tuple[SparkColumn | None, list[Membership]]:
    """The criteria as one column, and the long lists that it refers to by marker."""
    if sum(w.compare.arguments for w in criteria) != len(arguments):
        raise StoreError(f"{sum(w.compare.arguments for w in criteria)} arguments are needed, {len(arguments)} given")
    rest, groups, joined = list(arguments), [[]], []
    for w in criteria:
        if w.or_ and groups[-1]:
            groups.append([])
        taken, rest = rest[: w.compare.arguments], rest[w.compare.arguments :]
        groups[-1].append(_one(entity, w, taken, joined))
    arms = [all_of(g) for g in groups if g]
    return (reduce(lambda a, b: a | b, arms) if arms else None), joined


def _one(entity: type[Entity], w: Where, args: list, joined: list[Membership]) -> SparkColumn:
    declared = entity.column(w.field)
    column = F.col(declared.name)
    kind = declared.spark_type
    if w.json_path:
        column, kind = F.get_json_object(column, w.json_path), "string"

    def value(v):
        return literal(v, kind) if w.json_path else declared.stored(v)

    op = w.compare
    if op is Compare.IS_NULL:
        return column.isNull()
    if op is Compare.IS_NOT_NULL:
        return column.isNotNull()
    if op in (Compare.IN, Compare.NOT_IN):
        values = list(dict.fromkeys(args[0] or []))
        if not values:  # an empty list excludes nothing, null rows included
            return F.lit(op is Compare.NOT_IN)
        if len(values) > LIST_JOIN:
            marker = f"__in_{len(joined)}"
            converter = None if w.json_path else declared.converter
            held = [converter.row(v) if converter else v for v in values if v is not None]
            joined.append(Membership(marker, column, (converter and converter.decoded) or kind, held, converter and converter.to_stored))
            # null where the column is, and for what a list with a null does not find
            found = F.when(F.col(marker).isNotNull(), True).when(column.isNotNull() & F.lit(None not in values), False)
        else:
            found = column.isin([value(v) for v in values])
        return found if op is Compare.IN else ~found
    if op is Compare.LIKE or op is Compare.NOT_LIKE:
        # a backslash stands for itself: there is no escape
        like = column.like(args[0].replace("\\", "\\\\")) if args[0] is not None else F.lit(None).cast("boolean")
        return like if op is Compare.LIKE else ~like
    a = [value(v) for v in args]
    if op is Compare.BETWEEN:
        return column.between(a[0], a[1])
    if op is Compare.NOT_BETWEEN:
        return ~column.between(a[0], a[1])
    return {"=": column.__eq__, "<>": column.__ne__, ">": column.__gt__, ">=": column.__ge__, "<": column.__lt__, "<=": column.__le__}[op.value[0]](a[0])


def with_lists(df: DataFrame, joined: list[Membership]) -> DataFrame:
    """``df`` with the marker column of each long list."""
    for m in joined:
        listed = df.sparkSession.createDataFrame([(fitting(v, m.kind),) for v in m.values], f"__v {m.kind}")
        listed = listed.select((m.stored(F.col("__v")) if m.stored else F.col("__v")).alias("__v")).distinct().withColumn(m.marker, F.lit(True))
        df = df.join(F.broadcast(listed) if len(m.values) <= LIST_BROADCAST else listed, m.column == F.col("__v"), "left").drop("__v")
    return df


def filtered(df: DataFrame, entity: type[Entity], criteria: tuple[Where, ...], arguments: tuple, around: SparkColumn | None) -> DataFrame:
    """Rows of ``df`` that meet the criteria as a whole, and ``around``, which no OR arm escapes."""
    where, joined = condition(entity, criteria, arguments)
    both = all_of([c for c in (around, where) if c is not None])
    out = with_lists(df, joined)
    return (out if both is None else out.where(both)).select(*df.columns)


def keyset(columns: list[str], values: tuple, descending: bool = False) -> SparkColumn:
    """Rows after ``values`` in the order of ``columns``, in which nulls come first (descending: last), as an OR of arms."""
    arms = []
    for k, name in enumerate(columns):
        equal = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in zip(columns[:k], values)]
        column, value = F.col(name), values[k]
        if descending:
            beyond = F.lit(False) if value is None else (column < F.lit(value)) | column.isNull()
        else:
            beyond = column.isNotNull() if value is None else column > F.lit(value)
        arms.append(all_of([*equal, beyond]))
    return reduce(lambda a, b: a | b, arms)


def full_text(columns: list[str], term: str) -> SparkColumn:
    """Rows that have every word of ``term`` among the lower-cased words of ``columns``; an empty term finds nothing."""
    words = sorted({w for w in re.split(r"[^a-z0-9]+", term.lower()) if w})
    if not words:
        return F.lit(False)
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    # a plain containment test first: it is cheap, and most rows fail it before the pattern looks at the word's ends
    whole = [text.rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])") for w in words]
    return all_of([*[text.contains(w) for w in words], *whole])
