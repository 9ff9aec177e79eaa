"""Row filters: soft deletion and global filters, composed around every predicate."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..errors import DefinitionError, FilterValueMissing

if TYPE_CHECKING:
    from ..sources.entity import Entity

_scope: ContextVar[dict] = ContextVar("quern_filter_scope", default={})


@dataclass(frozen=True)
class GlobalFilter:
    """Keeps rows whose column equals ``keep_when``, or the value that the scope has under ``context_key``.

    A named filter can be bypassed by reads that say so; ``enforce_on_writes`` puts it on writes too.
    """

    keep_when: bool = True
    context_key: str | None = None
    name: str | None = None
    enforce_on_writes: bool = False


@contextlib.contextmanager
def filter_scope(**values) -> Iterator[None]:
    """Values for filters with a context key, in this block; an inner scope replaces the outer one, it does not add to it."""
    mark = _scope.set(dict(values))
    try:
        yield
    finally:
        _scope.reset(mark)


def all_of(conditions: list[SparkColumn]) -> SparkColumn | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def _kept(entity: type[Entity], column) -> SparkColumn:
    f = column.filter
    if f.context_key is None:
        return F.col(column.name) == F.lit(f.keep_when)
    value = _scope.get().get(f.context_key)
    if value is None:
        raise FilterValueMissing(f"{entity.__name__}.{column.name} is filtered by {f.context_key}, which no scope gives")
    if isinstance(value, bool) != (column.spark_type == "boolean") or isinstance(value, str) != (column.spark_type == "string"):
        raise FilterValueMissing(f"{f.context_key} is {value!r}, which {column.name} ({column.spark_type}) cannot equal")
    return F.col(column.name) == F.lit(value).cast(column.spark_type)


def not_deleted(entity: type[Entity]) -> SparkColumn | None:
    for c in entity.columns.values():
        if c.soft_delete:
            return ~F.col(c.name) if c.spark_type == "boolean" else F.col(c.name).isNull()
    return None


def active(entity: type[Entity], include_deleted: bool = False, ignore: tuple[str, ...] = ()) -> SparkColumn | None:
    """What reads add to every predicate. Values are taken from the scope now, not when the plan runs."""
    kept = [_kept(entity, c) for c in entity.columns.values() if c.filter and not (c.filter.name and c.filter.name in ignore)]
    alive = None if include_deleted else not_deleted(entity)
    return all_of(([alive] if alive is not None else []) + kept)


def enforced(entity: type[Entity]) -> SparkColumn | None:
    """What writes by key add: filters that are enforced on writes, and nothing else."""
    return all_of([_kept(entity, c) for c in entity.columns.values() if c.filter and c.filter.enforce_on_writes])


def check_ignored(entity: type[Entity], ignore: tuple[str, ...]) -> None:
    names = {c.filter.name for c in entity.columns.values() if c.filter and c.filter.name}
    for n in ignore:
        if n not in names:
            raise DefinitionError("no-filter-of-that-name", f"{entity.__name__} has no filter named {n}")
