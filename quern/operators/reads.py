"""Selects, pages and searches as lazy frames."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DefinitionError, StoreError
from ..functions.predicates import keyset
from ..sources.entity import Entity, Projection

MAX_PAGE = 2**31 - 1


def ordering(entity: type[Entity], text: str | None) -> list[tuple[str, bool]]:
    """(column, descending) of an order such as "A ASC, B DESC"."""
    out = []
    for part in (text or "").split(","):
        words = part.split()
        if not words:
            continue
        if len(words) > 2 or (len(words) == 2 and words[1].upper() not in ("ASC", "DESC")):
            raise DefinitionError("order-syntax", f"{part.strip()} is not a column with ASC or DESC")
        out.append((entity.column(words[0]).name, len(words) == 2 and words[1].upper() == "DESC"))
    return out


def where(df: DataFrame, *conditions: SparkColumn | None) -> DataFrame:
    for c in conditions:
        df = df if c is None else df.where(c)
    return df


def shown(df: DataFrame, entity: type[Entity], projection: type[Projection] | None, distinct: bool = False) -> DataFrame:
    """The columns that are returned, decoded where a converter says so; filters come before, so they may use others."""
    fields = projection.fields if projection else tuple(entity.columns)
    df = df.select(*[c.converter.from_stored(F.col(f)).alias(f) if (c := entity.columns[f]).converter else F.col(f) for f in fields])
    return df.distinct() if distinct else df


def ordered(df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in order]) if order else df


def offset_page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    if offset < 0 or limit <= 0:
        raise StoreError("an offset of 0 or more and a positive limit are needed")
    return df.offset(offset).limit(limit)


def key_page(df: DataFrame, columns: list[str], cursor: tuple | None, size: int, descending: bool) -> DataFrame:
    """``size`` rows after the cursor in key order: a filter and a top-k, which no sort of the table precedes."""
    if cursor is not None:
        if len(cursor) != len(columns):
            raise StoreError(f"the cursor needs {len(columns)} values")
        df = df.where(keyset(columns, cursor, descending))
    return ordered(df, [(c, descending) for c in columns]).limit(size)


@dataclass(frozen=True)
class Page:
    """Rows of a page, the cursor of the next one, and whether there is one."""

    items: list
    next_cursor: tuple | None
    has_more: bool


@dataclass(frozen=True)
class PagedResult:
    items: list
    total: int


def read_page(df: DataFrame, columns: list[str], cursor: tuple | None, size: int, descending: bool) -> Page:
    if size <= 0 or size >= MAX_PAGE:
        raise StoreError("a positive page size is needed")
    rows = key_page(df, columns, cursor, size + 1, descending).collect()
    items = rows[:size]
    more = len(rows) > size
    return Page(items, tuple(items[-1][c] for c in columns) if more else None, more)


def key_condition(entity: type[Entity], values: tuple[Any, ...]) -> SparkColumn:
    if len(values) != len(entity.keys):
        raise StoreError(f"{entity.__name__} has {len(entity.keys)} key columns, {len(values)} values given")
    return equalities(entity, [k.name for k in entity.keys], values)


def equalities(entity: type[Entity], fields: list[str], values: tuple[Any, ...]) -> SparkColumn:
    """Plain equality of each column: a null value equals nothing."""
    out = None
    for f, v in zip(fields, values):
        c = entity.columns[f]
        one = F.col(f) == c.stored(v)
        out = one if out is None else out & one
    return out
