"""Related rows: semi-joins, junctions and eager loading as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import active
from ..sources.entity import BelongsTo, Entity, HasMany, ManyToMany
from .reads import where

Frames = Callable[[type[Entity]], DataFrame]


def active_rows(frames: Frames, entity: type[Entity], include_deleted: bool = False) -> DataFrame:
    return where(frames(entity), active(entity, include_deleted))


def children_of(frames: Frames, parents: DataFrame, parent: type[Entity], relation: HasMany) -> DataFrame:
    """Active children of any of ``parents``; a child without a parent key has none."""
    keys = parents.select(F.col(parent.keys[0].name).alias("__key"))
    rows = active_rows(frames, relation.target)
    return rows.join(keys, rows[relation.foreign_key] == keys["__key"], "left_semi")


def parent_of(frames: Frames, rows: DataFrame, relation: BelongsTo) -> DataFrame:
    """Active parents that any of ``rows`` names."""
    target = relation.target
    keys = rows.select(F.col(relation.foreign_key).alias("__key"))
    parents = active_rows(frames, target)
    return parents.join(keys, parents[target.keys[0].name] == keys["__key"], "left_semi")


def junction_rows(frames: Frames, parents: DataFrame, parent: type[Entity], relation: ManyToMany) -> DataFrame:
    """__parent and __child_k of active junction rows whose parent is among ``parents`` and whose child is active."""
    target = relation.target
    links = _links(frames, parents, parent, relation)
    kept = active_rows(frames, target).select(*[F.col(k.name).alias(f"__child_{i}") for i, k in enumerate(target.keys)])
    return links.join(kept, kept.columns, "left_semi")


def _links(frames: Frames, parents: DataFrame | None, parent: type[Entity], relation: ManyToMany) -> DataFrame:
    junction, parent_key, child_keys = relation.through(parent)
    rows = active_rows(frames, junction).select(F.col(parent_key).alias("__parent"), *[F.col(c).alias(f"__child_{i}") for i, c in enumerate(child_keys)])
    if parents is None:
        return rows
    keys = parents.select(F.col(parent.keys[0].name).alias("__parent"))
    return rows.join(keys, "__parent", "left_semi")


def linked_rows(frames: Frames, parents: DataFrame | None, parent: type[Entity], relation: ManyToMany) -> DataFrame:
    """__parent and the child's columns: one row for each junction row, so repeated junction rows repeat the child.

    ``parents`` restricts the links before they are joined; None takes all, for those who join the parents afterwards.
    """
    links = _links(frames, parents, parent, relation)
    target = relation.target
    child = active_rows(frames, target)
    on = [child[k.name] == links[f"__child_{i}"] for i, k in enumerate(target.keys)]
    return child.join(links, on).select("__parent", *[child[c] for c in target.columns])


def related_rows(frames: Frames, parents: DataFrame | None, parent: type[Entity], name: str) -> DataFrame:
    """__parent and the related entity's columns, for a collection relation; ``parents`` as in ``linked_rows``."""
    relation = parent.relations[name]
    if isinstance(relation, ManyToMany):
        return linked_rows(frames, parents, parent, relation)
    rows = active_rows(frames, relation.target) if parents is None else children_of(frames, parents, parent, relation)
    return rows.select(F.col(relation.foreign_key).alias("__parent"), *relation.target.columns)


def _fields(target: type[Entity], fields: tuple[str, ...] | None) -> list[str]:
    """The columns asked for, or all; keys first, as lists are in their order."""
    wanted = list(target.columns) if fields is None else [target.column(f).name for f in fields]
    keys = [k.name for k in target.keys]
    return [*keys, *[c for c in wanted if c not in keys]]


def flat(frames: Frames, parents: DataFrame, parent: type[Entity], name: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Parents beside related rows (prefixed ``<relation>_``), one row a pair, and one with nulls where there are none.

    This is the form for parents with very many children: the join splits a hot parent, and no list is built.
    """
    relation = parent.relations[name]
    target = relation.target
    columns = [F.col(c).alias(f"{name}_{c}") for c in (target.columns if fields is None else _fields(target, fields))]
    if isinstance(relation, BelongsTo):
        rows = active_rows(frames, target).select(*columns)
        return parents.join(rows, F.col(relation.foreign_key) == F.col(f"{name}_{target.keys[0].name}"), "left")
    rows = related_rows(frames, None, parent, name).select("__parent", *columns)
    return parents.join(rows, F.col(parent.keys[0].name) == F.col("__parent"), "left").drop("__parent")


def eager(frames: Frames, parents: DataFrame, parent: type[Entity], names: tuple[str, ...], fields: dict[str, tuple[str, ...]] | None = None, few: bool = False) -> DataFrame:
    """Parents with a column for each relation: a list of structs by the related key, or one struct, or null.

    ``few`` says that the parents are a small part of their table, so that related rows are worth restricting to theirs first.

    Children are gathered by their parent's key after they are filtered, and with the ``fields`` of their relation only, so
    nothing else is shuffled; a parent without any has an empty list. A list lies in one row: where a parent may have more
    children than a row should hold, ``flat`` is the form to take.
    """
    out = parents
    for name in names:
        relation = parent.relations[name]
        columns = _fields(relation.target, (fields or {}).get(name))
        if isinstance(relation, BelongsTo):
            key = relation.target.keys[0].name
            rows = active_rows(frames, relation.target).select(F.col(key).alias("__key"), F.struct(*columns).alias(name))
            out = out.join(rows, out[relation.foreign_key] == rows["__key"], "left").drop("__key")
        else:
            rows = related_rows(frames, parents if few else None, parent, name).where("__parent is not null").groupBy("__parent").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
            out = out.join(rows, out[parent.keys[0].name] == rows["__parent"], "left").drop("__parent")
            out = out.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out
