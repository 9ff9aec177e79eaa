"""Declared entities: columns and their roles, relations, projections and views."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..errors import DefinitionError
from ..functions.filters import GlobalFilter
from ..functions.values import literal

#: Logical types by their Spark type; unsigned ones are widened, so that they order by value.
TYPES = {
    "string": "string", "char": "string", "guid": "string", "json": "string", "bool": "boolean", "byte": "smallint", "sbyte": "tinyint", "short": "smallint", "ushort": "int",
    "int": "int", "uint": "bigint", "long": "bigint", "ulong": "decimal(20,0)", "float": "float", "double": "double", "decimal": "decimal(18,2)",
    "datetime": "timestamp_ntz", "instant": "timestamp", "date": "date", "time": "string", "binary": "binary",
}
INTEGERS = frozenset({"tinyint", "smallint", "int", "bigint"})
_NESTED = re.compile(r"decimal\(\d+,\s*\d+\)|(array|map|struct)<.+>")
AUDIT = ("created_at", "created_by", "modified_at", "modified_by")


@dataclass(frozen=True)
class Converter:
    """How a value is stored: both directions are column expressions, so they stay inside the plan.

    ``decoded`` is the type of a decoded value (None: the column's own); ``of`` makes a decoded column of a Python value, and
    ``row`` what stands for that value in a row.
    """

    to_stored: Callable[[SparkColumn], SparkColumn]
    from_stored: Callable[[SparkColumn], SparkColumn]
    decoded: str | None = None
    of: Callable[[Any], SparkColumn] = F.lit
    row: Callable[[Any], Any] = lambda v: v


def as_json(schema: str) -> Converter:
    """Values of a Spark type, kept as JSON text; Python values are dicts and lists."""
    return Converter(F.to_json, lambda c: F.from_json(c, schema), schema, lambda v: F.from_json(F.lit(None if v is None else json.dumps(v)), schema))


def as_name(kind: type[Enum]) -> Converter:
    """Members of an enum, kept as their names; a name that the enum has not is refused before anything runs."""

    def name(v: Any) -> str | None:
        return v if v is None else v.name if isinstance(v, Enum) else kind[v].name

    return Converter(lambda c: c, lambda c: c, "string", lambda v: F.lit(name(v)), name)


@dataclass
class Column:
    """A column and its role; ``type`` is a logical type or a Spark type's name."""

    type: str
    name: str | None = None
    key: bool = False
    nullable: bool = True
    generated: bool = False
    sequential_guid: bool = False
    store_default: str | None = None
    computed: str | None = None
    references: str | None = None
    soft_delete: bool = False
    filter: GlobalFilter | None = None
    token: bool = False
    audit: str | None = None
    converter: Converter | None = None
    indexed: bool = False
    unique: bool = False
    check: str | None = None
    on_delete: str | None = None
    attribute: str = field(default="", init=False)

    @property
    def spark_type(self) -> str:
        return TYPES.get(self.type, self.type)

    def stored(self, value: Any) -> SparkColumn:
        """A Python value as a column that holds it as it is stored."""
        return self.converter.to_stored(self.converter.of(value)).cast(self.spark_type) if self.converter else literal(value, self.spark_type)

    @property
    def insertable(self) -> bool:
        return not (self.generated or self.computed or self.store_default)

    @property
    def updatable(self) -> bool:
        return not (self.key or self.generated or self.computed or self.token or self.audit in ("created_at", "created_by"))


@dataclass(frozen=True)
class HasMany:
    """Children whose ``foreign_key`` names this entity's key."""

    child: Callable[[], type[Entity]] | type[Entity]
    foreign_key: str

    @property
    def target(self) -> type[Entity]:
        return self.child if isinstance(self.child, type) else self.child()


@dataclass(frozen=True)
class BelongsTo:
    """The one row that this entity's ``foreign_key`` names."""

    parent: Callable[[], type[Entity]] | type[Entity]
    foreign_key: str

    @property
    def target(self) -> type[Entity]:
        return self.parent if isinstance(self.parent, type) else self.parent()


@dataclass(frozen=True)
class ManyToMany:
    """Rows of another entity through a junction; without one, a read-only junction table is named after both tables."""

    child: Callable[[], type[Entity]] | type[Entity]
    junction: type[Entity] | None = None
    parent_key: str | None = None
    child_keys: tuple[str, ...] = ()

    @property
    def target(self) -> type[Entity]:
        return self.child if isinstance(self.child, type) else self.child()

    def through(self, parent: type[Entity]) -> tuple[type[Entity], str, tuple[str, ...]]:
        if self.junction is not None:
            return self.junction, self.parent_key or "", tuple(self.child_keys)
        tables = sorted((parent.table, self.target.table))
        own = f"{parent.table}_{parent.keys[0].name}"
        others = tuple(f"{self.target.table}_{k.name}" for k in self.target.keys)
        columns = {own: Column(parent.keys[0].type, key=True)} | {o: Column(k.type, key=True) for o, k in zip(others, self.target.keys)}
        made = type(f"{tables[0]}_{tables[1]}", (Entity,), columns, table="_".join(tables))
        return made, own, others


class _Keys:
    """The key columns of the class it is read from."""

    def __get__(self, _, cls) -> list[Column]:
        return [c for c in getattr(cls, "columns", {}).values() if c.key]


class Entity:
    """A table. Subclasses declare columns and relations as attributes; the class is checked when it is defined."""

    table: str
    columns: dict[str, Column]
    relations: dict[str, HasMany | BelongsTo | ManyToMany]
    view: bool = False
    keys = _Keys()

    def __init_subclass__(cls, table: str | None = None, view: bool = False, **kwargs):
        super().__init_subclass__(**kwargs)
        cls.table = table or cls.__name__
        cls.view = view
        cls.columns, cls.relations = {}, {}
        for attribute, c in vars(cls).copy().items():
            if isinstance(c, Column):
                c.name, c.attribute = c.name or attribute, attribute
                cls.columns[c.name] = c
            elif isinstance(c, (HasMany, BelongsTo, ManyToMany)):
                cls.relations[attribute] = c
        cls._check()

    @classmethod
    def _check(cls) -> None:
        def refuse(code: str, message: str):
            raise DefinitionError(code, f"{cls.__name__}: {message}")

        if not cls.view and not cls.keys:
            refuse("no-key", "a table needs a key")
        if len(cls.keys) > 1 and any(c.generated for c in cls.keys):
            refuse("generated-composite-key", "a composite key cannot be generated")
        if len({n.lower() for n in cls.columns}) < len(cls.columns):
            refuse("same-column-name", "two columns have the same name")
        for c in cls.columns.values():
            if c.spark_type not in TYPES.values() and not _NESTED.fullmatch(c.spark_type):
                refuse("no-type", f"{c.name} has no such type: {c.type}")
            if c.generated and c.spark_type not in INTEGERS:
                refuse("generated-key-type", f"{c.name} is generated and must be an integer")
            if c.soft_delete and not (c.spark_type == "boolean" or (c.spark_type.startswith("timestamp") and c.nullable)):
                refuse("deletion-mark-type", f"{c.name} marks deletion and must be a boolean or a nullable time")
            if c.audit and c.audit not in AUDIT:
                refuse("no-audit-role", f"{c.name} has no such audit role: {c.audit}")
            if c.filter and c.filter.context_key is None and c.spark_type != "boolean":
                refuse("constant-filter-type", f"{c.name} is filtered by a constant and must be a boolean")
        for role in ("soft_delete", "token"):
            if sum(bool(getattr(c, role)) for c in cls.columns.values()) > 1:
                refuse("role-twice", f"more than one {role} column")

    @classmethod
    def column(cls, name: str) -> Column:
        """By name or attribute, whatever the case."""
        for c in cls.columns.values():
            if name.lower() in (c.name.lower(), c.attribute.lower()):
                return c
        raise DefinitionError("no-column", f"{cls.__name__} has no column {name}")


class Projection:
    """Names some of an entity's columns, in its own order."""

    entity: type[Entity]
    fields: tuple[str, ...]

    def __init_subclass__(cls, entity: type[Entity], fields: tuple[str, ...], **kwargs):
        super().__init_subclass__(**kwargs)
        cls.entity, cls.fields = entity, tuple(entity.column(f).name for f in fields)


class AdHoc:
    """Names for the columns of hand-written SQL, by position."""

    fields: tuple[str, ...]

    def __init_subclass__(cls, fields: tuple[str, ...], **kwargs):
        super().__init_subclass__(**kwargs)
        cls.fields = tuple(fields)
