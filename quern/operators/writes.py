"""Changes as functions of a table's state: FLAG marks the rows that are touched, and the state after follows from the marked one.

A deletion keeps rows for which its predicate is unknown; an update changes only rows for which it is true.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StoreError
from ..functions.filters import enforced
from ..functions.guid import sequential_guid
from ..functions.values import literal
from ..sources.entity import Entity
from ..sources.states import FLAG


def sure(condition: SparkColumn | None) -> SparkColumn:
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def _time(c, now: datetime) -> SparkColumn:
    return literal(now if c.spark_type == "timestamp" else now.astimezone(UTC).replace(tzinfo=None) if now.tzinfo else now, c.spark_type)


def stamped(entity: type[Entity], rows: DataFrame, now: datetime, user: str | None, inserting: bool) -> DataFrame:
    """New rows with defaults, guids, audit columns and computed columns filled in, encoded for storage."""
    out = rows
    for c in entity.columns.values():
        given = F.col(c.name) if c.name in rows.columns else F.lit(None).cast(c.spark_type)
        if c.converter and c.name in rows.columns:
            given = c.converter.to_stored(given)
        if c.computed:
            continue
        if c.sequential_guid:
            given = F.coalesce(given, sequential_guid())
        elif c.store_default and inserting:
            given = F.expr(c.store_default)
        elif c.token and inserting:
            given = F.coalesce(given, F.lit(0))
        elif c.audit and (inserting or c.audit.startswith("modified")):
            stamp = _time(c, now) if c.audit.endswith("_at") else F.lit(user).cast("string")
            given = F.coalesce(given, stamp) if c.audit.startswith("created") else stamp
        elif c.soft_delete and c.spark_type == "boolean":
            given = F.coalesce(given, F.lit(False))
        out = out.withColumn(c.name, given.cast(c.spark_type))
    return with_computed(entity, out).select(*entity.columns)


def with_computed(entity: type[Entity], df: DataFrame) -> DataFrame:
    for c in entity.columns.values():
        if c.computed:
            df = df.withColumn(c.name, F.expr(c.computed).cast(c.spark_type))
    return df


def marked(state: DataFrame, condition: SparkColumn | None) -> DataFrame:
    return state.withColumn(FLAG, sure(condition))


def with_set(entity: type[Entity], state: DataFrame, values: dict[str, SparkColumn], now: datetime | None = None, user: str | None = None) -> DataFrame:
    """The given columns, and if a time is given the token and the modification stamps, set in the marked rows."""
    sets = dict(values)
    for c in entity.columns.values() if now else ():
        if c.token:
            sets[c.name] = F.col(c.name) + 1
        elif c.audit == "modified_at":
            sets[c.name] = _time(c, now)
        elif c.audit == "modified_by":
            sets[c.name] = F.lit(user).cast("string")
    out = state.select(*[F.when(F.col(FLAG), sets[c.name]).otherwise(F.col(c.name)).cast(c.spark_type).alias(c.name) if c.name in sets else F.col(c.name) for c in entity.columns.values()])
    return with_computed(entity, out)


def without(state: DataFrame) -> DataFrame:
    """The rows that are not marked."""
    return state.where(~F.col(FLAG)).drop(FLAG)


def deletion(entity: type[Entity], now: datetime) -> dict[str, SparkColumn]:
    """What a soft deletion sets, the token too."""
    c = next(c for c in entity.columns.values() if c.soft_delete)
    token = {t.name: F.col(t.name) + 1 for t in entity.columns.values() if t.token}
    return {c.name: F.lit(True) if c.spark_type == "boolean" else _time(c, now)} | token


def restoration(entity: type[Entity]) -> dict[str, SparkColumn]:
    c = next(c for c in entity.columns.values() if c.soft_delete)
    return {c.name: F.lit(False) if c.spark_type == "boolean" else F.lit(None).cast(c.spark_type)}


def one_row_a_key(entity: type[Entity], rows: DataFrame) -> None:
    """Refuses a batch that has several rows with one key, or a row without one."""
    keys = [k.name for k in entity.keys]
    bad = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(" or ".join(["n > 1", *[f"`{k}` is null" for k in keys]])).first()
    if bad:
        raise StoreError(f"the batch has {bad['n']} rows with key {tuple(bad[k] for k in keys)}")


def new_keys(entity: type[Entity], state: DataFrame, rows: DataFrame) -> None:
    """Refuses rows whose key the batch has twice or the table has already: only keys are read."""
    one_row_a_key(entity, rows)
    keys = [k.name for k in entity.keys]
    there = state.select(*keys).join(rows.select(*keys), keys, "left_semi").first()
    if there:
        raise StoreError(f"{entity.table} has a row with key {tuple(there)} already")


def marked_by_keys(entity: type[Entity], state: DataFrame, keys: DataFrame) -> DataFrame:
    """Marks rows whose key is among ``keys`` (each once) and that the filters enforced on writes let through."""
    names = [k.name for k in entity.keys]
    out = state.join(keys.select(*names, F.lit(True).alias(FLAG)), names, "left")
    return out.withColumn(FLAG, sure(F.col(FLAG)) & sure(enforced(entity))).select(*entity.columns, FLAG)


def marked_beside(entity: type[Entity], state: DataFrame, rows: DataFrame) -> DataFrame:
    """The state beside the new values of ``rows``, joined once by key; marked as in ``marked_by_keys``."""
    names = [k.name for k in entity.keys]
    given = rows.select(*names, *[F.col(c.name).alias(f"__v_{c.name}") for c in _settable(entity, rows)], F.lit(True).alias(FLAG))
    return state.join(given, names, "left").withColumn(FLAG, sure(F.col(FLAG)) & sure(enforced(entity)))


def _settable(entity: type[Entity], rows: DataFrame) -> list:
    return [c for c in entity.columns.values() if c.updatable and not c.soft_delete and c.name in rows.columns]


def with_values(entity: type[Entity], state: DataFrame) -> DataFrame:
    """Marked rows of ``marked_beside`` with their new values."""
    return with_set(entity, state, {c: F.col(f"__v_{c}") for c in entity.columns if f"__v_{c}" in state.columns})


def merged(entity: type[Entity], state: DataFrame, rows: DataFrame) -> DataFrame:
    """State and ``rows`` in one full join by key, marked where ``rows`` has the key."""
    names = [k.name for k in entity.keys]
    old = state.select(*names, *[F.col(c).alias(f"__o_{c}") for c in entity.columns if c not in names], F.lit(True).alias("__old"))
    return old.join(rows.withColumn(FLAG, F.lit(True)), names, "full").withColumn(FLAG, sure(F.col(FLAG)))


def with_rows(entity: type[Entity], state: DataFrame) -> DataFrame:
    """Rows of ``merged`` after an upsert: those given, keeping creation stamps of rows that were there, beside the others."""
    names = [k.name for k in entity.keys]
    sets = any(c.updatable for c in entity.columns.values())  # nothing to set: rows that are there stay

    def column(c):
        if c.name in names:
            return F.col(c.name)
        stays = ~F.col(FLAG) if c.updatable and sets else sure(F.col("__old"))
        return F.when(stays, F.col(f"__o_{c.name}")).otherwise(F.col(c.name)).alias(c.name)

    return with_computed(entity, state.select(*[column(c) for c in entity.columns.values()]))
