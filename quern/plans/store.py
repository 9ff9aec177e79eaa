"""Declared stores: operations are attributes, checked when the class is defined and bound to rows at each call."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConcurrencyConflict, DefinitionError, StoreError
from ..functions.filters import active, all_of, check_ignored, enforced
from ..functions.predicates import Where, check, condition, filtered, full_text, with_lists
from ..functions.values import fitting
from ..operators import adhoc, aggregates, reads, relations, writes
from ..sources.entity import BelongsTo, Entity, ManyToMany, Projection
from .hooks import Hooks


@dataclass
class Options:
    """How a store behaves: whether a lost race raises or returns, and who is stamped into audit columns."""

    throw_on_conflict: bool = False
    user: str | None = None


class Operation:
    """An attribute of a store class; ``define`` checks it once, ``run`` binds it."""

    writes = False
    keyed = False

    def __set_name__(self, owner, name):
        self.name = name

    def __get__(self, store, owner=None):
        if store is None:
            return self
        return lambda *args, **kwargs: store.hooks.run(type(store).__name__, self.name, args, lambda: self.run(store, *args, **kwargs))

    def define(self, entity: type[Entity]) -> None:
        pass

    def run(self, store: Store, *args):
        raise NotImplementedError


class Read(Operation):
    """Options that reads share. ``lock`` is refused: a read sees one version of the files, and locks no row."""

    def __init__(self, *, include_deleted=False, ignore_filters: Iterable[str] = (), projection: type[Projection] | None = None, distinct=False, order_by: str | None = None, paged=False, lock: str | None = None):
        self.include_deleted, self.ignore, self.projection, self.distinct, self.paged = include_deleted, tuple(ignore_filters), projection, distinct, paged
        self.order_by, self.lock = order_by, lock
        self.order: list[tuple[str, bool]] = []

    def define(self, entity):
        if self.lock:
            raise DefinitionError("no-row-locks", f"{self.name}: rows cannot be locked")
        check_ignored(entity, self.ignore)
        if self.projection and self.projection.entity is not entity:
            raise DefinitionError("projection-of-another", f"{self.name}: the projection is of {self.projection.entity.__name__}")
        self.order = reads.ordering(entity, self.order_by)
        if self.paged and not self.order:
            raise DefinitionError("page-without-order", f"{self.name}: a page needs an order")
        shown = self.projection.fields if self.projection else entity.columns
        if self.distinct and any(c not in shown for c, _ in self.order):
            raise DefinitionError("order-not-shown", f"{self.name}: distinct rows can only be ordered by what is returned")

    def active(self, store):
        return active(store.entity, self.include_deleted, self.ignore)

    def finish(self, store, df: DataFrame, page: tuple) -> DataFrame:
        if not self.distinct:
            df = reads.ordered(df, self.order)
            df = reads.offset_page(df, *page) if self.paged else df
            return reads.shown(df, store.entity, self.projection)
        df = reads.ordered(reads.shown(df, store.entity, self.projection, True), self.order)
        return reads.offset_page(df, *page) if self.paged else df

    def _page(self, args: tuple, kept: int) -> tuple[tuple, tuple]:
        if self.paged and len(args) != kept + 2:
            raise StoreError(f"{self.name} takes {kept} arguments, an offset and a limit")
        if not self.paged and len(args) != kept:
            raise StoreError(f"{self.name} takes {kept} arguments")
        return args[:kept], args[kept:]


class SelectAll(Read):
    def run(self, store, *args):
        _, page = self._page(args, 0)
        return self.finish(store, reads.where(store.rows(), self.active(store)), page)


class SelectAllByField(Read):
    """Rows equal in the given fields; without fields, those that the attribute's name lists after its first "by"."""

    def __init__(self, *fields: str, **options):
        super().__init__(**options)
        self.fields = list(fields)

    def define(self, entity):
        super().define(entity)
        self.fields = [entity.column(f).name for f in self.fields or named_fields(self.name)]
        if not self.fields:
            raise DefinitionError("no-fields", f"{self.name}: no fields to select by")

    def matching(self, store, values):
        return reads.where(store.rows(), self.active(store), reads.equalities(store.entity, self.fields, values))

    def run(self, store, *args):
        values, page = self._page(args, len(self.fields))
        return self.finish(store, self.matching(store, values), page)


class PagedResult(SelectAllByField):
    """A page and the number of all rows that match; two reads, each of its own moment."""

    def __init__(self, *fields: str, **options):
        super().__init__(*fields, paged=True, **options)

    def define(self, entity):
        if self.distinct:
            raise DefinitionError("total-of-distinct", f"{self.name}: a total cannot be counted beside distinct rows")
        if self.fields:
            super().define(entity)
        else:
            Read.define(self, entity)

    def matching(self, store, values):
        return super().matching(store, values) if self.fields else reads.where(store.rows(), self.active(store))

    def run(self, store, *args):
        values, page = self._page(args, len(self.fields))
        rows = self.matching(store, values)
        return reads.PagedResult(self.finish(store, rows, page).collect(), adhoc.scalar(aggregates.count(rows), 0))


class SelectOneByKey(Read):
    keyed = True

    def run(self, store, *key):
        return reads.shown(reads.where(store.rows(), self.active(store), reads.key_condition(store.entity, key)).limit(1), store.entity, self.projection)


class SelectByPredicate(Read):
    def __init__(self, *criteria: Where, **options):
        super().__init__(**options)
        self.criteria = criteria

    def define(self, entity):
        super().define(entity)
        if self.order or self.paged:
            raise DefinitionError("order-on-predicate", f"{self.name}: a predicate select has no order and no pages")
        check(entity, self.criteria)

    def run(self, store, *args):
        return self.finish(store, filtered(store.rows(), store.entity, self.criteria, args, self.active(store)), ())


class TopByOrder(Read):
    """The first row by one column; among equal ones any."""

    def __init__(self, column: str, descending: bool = False, **options):
        super().__init__(**options)
        self.column, self.descending = column, descending

    def define(self, entity):
        super().define(entity)
        self.order = [(entity.column(self.column).name, self.descending)]

    def run(self, store):
        return reads.shown(reads.ordered(reads.where(store.rows(), self.active(store)), self.order).limit(1), store.entity, self.projection)


class KeysetPage(Read):
    """Pages by the last key seen. ``run`` gives a lazy page of rows; ``read`` one with the next cursor."""

    def __init__(self, *columns: str, descending: bool = False, **options):
        super().__init__(**options)
        self.columns, self.descending = columns, descending

    def define(self, entity):
        super().define(entity)
        self.columns = tuple(entity.column(c).name for c in self.columns or [k.name for k in entity.keys])
        if self.include_deleted:
            raise DefinitionError("deleted-in-key-pages", f"{self.name}: pages by key hold active rows only")

    def _rows(self, store):
        return reads.shown(reads.where(store.rows(), self.active(store)), store.entity, self.projection)

    def run(self, store, cursor=None, size=50):
        return reads.read_page(self._rows(store), list(self.columns), cursor, size, self.descending)

    def frame(self, store, cursor=None, size=50) -> DataFrame:
        return reads.key_page(self._rows(store), list(self.columns), cursor, size, self.descending)


class Count(Read):
    def run(self, store):
        return aggregates.count(reads.where(store.rows(), self.active(store)))


class Exists(Read):
    def __init__(self, *criteria: Where, **options):
        super().__init__(**options)
        self.criteria = criteria

    def define(self, entity):
        super().define(entity)
        check(entity, self.criteria)

    def run(self, store, *args):
        return aggregates.exists(filtered(store.rows(), store.entity, self.criteria, args, self.active(store)))


class Aggregate(Read):
    def __init__(self, function: str, column: str, **options):
        super().__init__(**options)
        self.function, self.column = function, column

    def define(self, entity):
        super().define(entity)
        c = entity.column(self.column)
        self.column = c.name
        if self.function not in aggregates.FUNCTIONS:
            raise DefinitionError("no-aggregate", f"{self.name}: no such aggregate: {self.function}")
        if self.function in ("sum", "avg") and c.spark_type in ("string", "boolean", "binary", "date") or c.spark_type.startswith("timestamp") and self.function in ("sum", "avg"):
            raise DefinitionError("aggregate-of-no-number", f"{self.name}: {self.function} needs numbers")

    def run(self, store):
        return aggregates.aggregate(reads.where(store.rows(), self.active(store)), self.function, self.column)


class GroupCount(Read):
    def __init__(self, column: str, **options):
        super().__init__(**options)
        self.column = column

    def define(self, entity):
        super().define(entity)
        self.column = entity.column(self.column).name

    def run(self, store):
        return aggregates.group_count(reads.where(store.rows(), self.active(store)), self.column)


class FullTextSearch(Read):
    def __init__(self, *columns: str, **options):
        super().__init__(**options)
        self.columns = columns

    def define(self, entity):
        super().define(entity)
        if not self.columns or any(entity.column(c).spark_type != "string" for c in self.columns):
            raise DefinitionError("search-in-no-text", f"{self.name}: text columns are searched")
        self.columns = tuple(entity.column(c).name for c in self.columns)

    def run(self, store, term: str):
        return self.finish(store, reads.where(store.rows(), self.active(store), full_text(list(self.columns), term)), ())


class SelectAllEager(Read):
    """All rows with related ones in columns; see ``relations.eager``. ``include_deleted`` is for the parents only.

    ``fields`` names, for a relation, the columns of its rows that are wanted.
    """

    def __init__(self, *names: str, fields: dict[str, tuple[str, ...]] | None = None, **options):
        super().__init__(**options)
        self.names, self.fields = names, fields or {}

    def define(self, entity):
        super().define(entity)
        if self.ignore:
            raise DefinitionError("eager-bypass", f"{self.name}: eager reads bypass no filter")
        for n in (*self.names, *self.fields):
            if n not in entity.relations:
                raise DefinitionError("no-relation", f"{entity.__name__} has no relation {n}")
            for f in self.fields.get(n, ()):
                entity.relations[n].target.column(f)
            relation = entity.relations[n]
            if not isinstance(relation, BelongsTo) and len(entity.keys) != 1:
                raise DefinitionError("composite-parent-key", f"{self.name}: related rows are gathered by one key column")
            if not isinstance(relation, ManyToMany) and len(relation.target.keys) != 1:
                raise DefinitionError("composite-related-key", f"{self.name}: {n} has a composite key")
            if any(c.filter and c.filter.context_key for e in (entity, relation.target) for c in e.columns.values()):
                raise DefinitionError("eager-context-filter", f"{self.name}: eager reads take no filter with a context key")

    def parents(self, store):
        return reads.where(store.rows(), self.active(store))

    def run(self, store):
        return relations.eager(store.tables.frame, self.parents(store), store.entity, self.names, self.fields)

    def flat(self, store, name: str) -> DataFrame:
        return relations.flat(store.tables.frame, self.parents(store), store.entity, name, self.fields.get(name))


class SelectOneEager(SelectAllEager):
    keyed = True

    def run(self, store, *key):
        one = reads.where(self.parents(store), reads.key_condition(store.entity, key)).limit(1)
        return relations.eager(store.tables.frame, one, store.entity, self.names, self.fields, few=True)


class SelectRelated(Read):
    """Related rows of one parent by its key, through the junction where there is one."""

    def __init__(self, relation: str, **options):
        super().__init__(**options)
        self.relation = relation

    def define(self, entity):
        super().define(entity)
        if self.relation not in entity.relations:
            raise DefinitionError("no-relation", f"{entity.__name__} has no relation {self.relation}")

    def run(self, store, *key):
        parents = reads.where(store.rows(), self.active(store), reads.key_condition(store.entity, key))
        relation = store.entity.relations[self.relation]
        if isinstance(relation, BelongsTo):
            return relations.parent_of(store.tables.frame, parents, relation)
        return relations.related_rows(store.tables.frame, parents, store.entity, self.relation).drop("__parent")


# writes


class Write(Operation):
    writes = True

    def touch(self, store, where: SparkColumn | None, finish, lists=()) -> int:
        """The state after ``finish`` of the rows that meet ``where``; how many they are."""
        return store.changeable().replace(store.entity, writes.marked(with_lists(store.rows(), lists), where), finish)


class Insert(Write):
    """One row, given by its columns: its number, or with ``returning`` the row as stored. A key that is there is refused."""

    def __init__(self, returning: bool = False):
        self.returning = returning

    def run(self, store, **values):
        return store.insert_frame(store.as_frame([values]), self.returning)


class InsertAll(Write):
    """All rows of a frame or list, or none: a key that is there, or twice in the batch, is refused. Files are only added."""

    def run(self, store, rows):
        return store.insert_frame(store.as_frame(rows))


#: A batch of any size is one write of Spark's, so a bulk insert is the same operation.
BulkInsert = InsertAll


class Update(Write):
    """One row by its key, and its token if it has one: whether a row was changed, or with ``returning`` the row after."""

    keyed = True

    def __init__(self, returning: bool = False):
        self.returning = returning

    def run(self, store, **values):
        entity = store.entity
        given = store.named(values)
        keys = store.key_of(given)
        sets = {c.name: c.stored(given[c.name]) for c in entity.columns.values() if c.name in given and c.updatable and not c.soft_delete}
        now = store.now()
        n = self.touch(store, store.key_write(keys, given), lambda df: writes.with_set(entity, df, sets, now, store.options.user))
        if self.returning:
            return reads.shown(store.rows().where(reads.key_condition(entity, keys)), entity, None).first() if n else store.lost(None)
        return True if n else store.lost(False)


class UpdateAll(Write):
    keyed = True

    def define(self, entity):
        if any(c.token for c in entity.columns.values()):
            raise DefinitionError("batch-with-token", f"{self.name}: rows with a token are updated one by one")

    def run(self, store, rows) -> int:
        entity = store.entity
        given = store.as_frame(rows)
        stamped = ("modified_at", "modified_by")
        given = writes.stamped(entity, given, store.now(), store.options.user, False).select(*[c for c in entity.columns if c in given.columns or entity.columns[c].audit in stamped])
        writes.one_row_a_key(entity, given)
        return store.changeable().replace(entity, writes.marked_beside(entity, store.rows(), given), lambda df: writes.with_values(entity, df))


class UpdateWhere(Write):
    """Sets ``columns`` (first arguments) in rows that meet the criteria (the other arguments) and are active."""

    def __init__(self, columns: tuple[str, ...], *criteria: Where):
        self.columns, self.criteria = columns, criteria

    def define(self, entity):
        if not self.criteria:
            raise DefinitionError("no-criterion", f"{self.name}: an update needs a criterion")
        self.columns = tuple(entity.column(c).name for c in self.columns)
        for c in self.columns:
            if not entity.columns[c].updatable or entity.columns[c].soft_delete:
                raise DefinitionError("column-not-settable", f"{self.name}: {c} cannot be set")
        check(entity, self.criteria)

    def run(self, store, *args) -> int:
        entity, n = store.entity, len(self.columns)
        where, lists = condition(entity, self.criteria, args[n:])
        where = all_of([c for c in (active(entity), where) if c is not None])
        sets = {c: entity.columns[c].stored(v) for c, v in zip(self.columns, args)}
        now = store.now()
        return self.touch(store, where, lambda df: writes.with_set(entity, df, sets, now, store.options.user), lists)


class Upsert(Write):
    """Rows in place of those with their key, others added; a batch with a key twice is refused."""

    keyed = True

    def define(self, entity):
        if any(c.token for c in entity.columns.values()):
            raise DefinitionError("upsert-with-token", f"{self.name}: rows with a token are not upserted")
        if any(c.filter and c.filter.enforce_on_writes for c in entity.columns.values()):
            raise DefinitionError("upsert-past-filter", f"{self.name}: a filter enforced on writes forbids upserts")

    def run(self, store, rows=None, **values) -> int:
        entity = store.entity
        given = store.as_frame(rows) if rows is not None else store.as_frame([values])
        full = writes.stamped(entity, given, store.now(), store.options.user, True)
        made = [k.name for k in entity.keys if k.generated or k.sequential_guid]
        fresh = None
        if made:  # rows without a key are plain inserts
            missing = F.col(made[0]).isNull() if made[0] in given.columns else F.lit(True)
            fresh, given = given.where(missing), given.where(~missing)
            full = writes.stamped(entity, given, store.now(), store.options.user, True)
        writes.one_row_a_key(entity, full)
        n = store.changeable().replace(entity, writes.merged(entity, store.rows(), full), lambda df: writes.with_rows(entity, df))
        return n + (store.insert_frame(fresh) if fresh is not None else 0)


class Delete(Write):
    """One row by its key, and its token: flagged if the entity deletes softly and ``hard`` is not asked for."""

    keyed = True

    def __init__(self, hard: bool = False, returning: bool = False):
        self.hard, self.returning = hard, returning

    def run(self, store, *key, **values):
        given = store.named(values)
        where = store.key_write(tuple(key) or store.key_of(given), given)
        before = reads.shown(store.rows().where(writes.sure(where)), store.entity, None).first() if self.returning else None
        n = self.touch(store, where, store.removal(self.hard))
        if self.returning:
            return before if n else store.lost(None)
        return True if n else store.lost(False)


class DeleteAll(Write):
    """Rows whose single-column key is in the list, or in the one column of a frame."""

    keyed = True

    def __init__(self, hard: bool = False):
        self.hard = hard

    def define(self, entity):
        if len(entity.keys) != 1:
            raise DefinitionError("list-of-composite-keys", f"{self.name}: keys are listed by one column")

    def run(self, store, keys) -> int:
        entity = store.entity
        k = entity.keys[0]
        if not isinstance(keys, DataFrame):
            keys = store.spark.createDataFrame([(fitting(v, k.spark_type),) for v in set(keys)], f"`{k.name}` {k.spark_type}")
        given = keys.toDF(k.name).distinct()
        return store.changeable().replace(entity, writes.marked_by_keys(entity, store.rows(), given), store.removal(self.hard))


class DeleteWhere(Write):
    def __init__(self, *criteria: Where, hard: bool = False):
        self.criteria, self.hard = criteria, hard

    def define(self, entity):
        if not self.criteria:
            raise DefinitionError("no-criterion", f"{self.name}: a deletion needs a criterion")
        check(entity, self.criteria)

    def run(self, store, *args) -> int:
        where, lists = condition(store.entity, self.criteria, args)
        around = active(store.entity) if store.soft and not self.hard else enforced(store.entity)
        where = all_of([c for c in (around, where) if c is not None])
        return self.touch(store, where, store.removal(self.hard), lists)


class Restore(Write):
    keyed = True

    def define(self, entity):
        if not any(c.soft_delete for c in entity.columns.values()):
            raise DefinitionError("nothing-to-restore", f"{self.name}: only softly deleted rows can be restored")

    def run(self, store, *key) -> bool:
        entity = store.entity
        where = all_of([c for c in (reads.key_condition(entity, key), enforced(entity)) if c is not None])
        return self.touch(store, where, lambda df: writes.with_set(entity, df, writes.restoration(entity))) > 0


class Execute(Write):
    """A change as SQL text: an expression for which rows, and one for each column to set; without those, rows are removed.

    ``:name`` parameters are bound, never spliced. Nothing is added to the text: filters and deletion flags are its own affair.
    """

    def __init__(self, where: str, **sets: str):
        self.where, self.sets = where, sets

    def define(self, entity):
        for c in self.sets:
            if entity.column(c).computed or entity.column(c).key:
                raise DefinitionError("column-not-settable", f"{self.name}: {c} cannot be set")

    def run(self, store, **parameters) -> int:
        entity = store.entity
        names = {entity.column(c).name: text for c, text in self.sets.items()}
        new = ", ".join(f"({text}) AS `__v_{c}`" for c, text in names.items())
        marked = adhoc.query(store.spark, f"SELECT *, coalesce({self.where}, false) AS `{writes.FLAG}`{', ' + new if new else ''} FROM {{state}}", frames={"state": store.rows()}, **parameters)
        finish = (lambda df: writes.with_values(entity, df)) if names else writes.without
        return store.changeable().replace(entity, marked, finish)


def named_fields(name: str) -> list[str]:
    """Fields that a method's name lists: find_by_country_and_city, or FindByCountryAndCityAsync."""
    if "_by_" in name:
        return name.split("_by_", 1)[1].split("_and_")
    m = re.search(r"By(?=[A-Z])", name)
    if not m:
        return []
    return re.split(r"(?<=[a-z0-9])And(?=[A-Z])", name[m.end() :].removesuffix("Async"))


class Store:
    """Operations over one entity, on tables given when it is made."""

    entity: type[Entity]
    operations: dict[str, Operation]

    def __init_subclass__(cls, entity: type[Entity] | None = None, **kwargs):
        super().__init_subclass__(**kwargs)
        if entity is None:
            raise DefinitionError("no-entity", f"{cls.__name__} needs an entity")
        cls.entity = entity
        cls.operations = {n: o for n, o in vars(cls).items() if isinstance(o, Operation)}
        for o in cls.operations.values():
            if entity.view and o.writes:
                raise DefinitionError("view-is-read-only", f"{o.name}: a view is only read")
            if o.keyed and not entity.keys:
                raise DefinitionError("no-key-to-find-by", f"{o.name}: {entity.__name__} has no key")
            o.define(entity)

    def __init__(self, tables, options: Options | None = None, hooks: Hooks | None = None):
        self.tables, self.options, self.hooks = tables, options or Options(), hooks or Hooks()

    @property
    def spark(self) -> SparkSession:
        return self.tables.spark

    @property
    def soft(self) -> bool:
        return any(c.soft_delete for c in self.entity.columns.values())

    def rows(self) -> DataFrame:
        return self.tables.frame(self.entity)

    def frame(self, operation: str, *args, **kwargs) -> DataFrame:
        """The lazy rows behind an operation whose call collects them."""
        return type(self).operations[operation].frame(self, *args, **kwargs)

    def now(self) -> datetime:
        return datetime.now(UTC)

    def changeable(self):
        if not hasattr(self.tables, "replace"):
            raise StoreError("these tables are only read")
        return self.tables

    def named(self, values: dict[str, Any]) -> dict[str, Any]:
        """Values by column, whether they are given by column or by attribute; other names are refused."""
        known = {c.attribute: c.name for c in self.entity.columns.values()} | {c: c for c in self.entity.columns}
        unknown = sorted(set(values) - set(known))
        if unknown:
            raise StoreError(f"{self.entity.__name__} has no columns {unknown}")
        return {known[n]: v for n, v in values.items()}

    def key_of(self, values: dict[str, Any]) -> tuple:
        missing = [k.name for k in self.entity.keys if k.name not in values]
        if missing:
            raise StoreError(f"{self.entity.__name__} is written by key; {missing} must be given")
        return tuple(values[k.name] for k in self.entity.keys)

    def as_frame(self, rows) -> DataFrame:
        """Rows as a frame of the columns that any of them gives; columns that the entity has not are refused."""
        if isinstance(rows, DataFrame):
            named = self.named({c: None for c in rows.columns})
            return rows.toDF(*named)
        given = [self.named(r) for r in rows]
        columns = [c for n, c in self.entity.columns.items() if any(n in r for r in given)]
        types = [(c.converter and c.converter.decoded) or c.spark_type for c in columns]

        def value(c, kind, v):
            return c.converter.row(v) if c.converter else fitting(v, kind)

        data = [tuple(value(c, t, r.get(c.name)) for c, t in zip(columns, types)) for r in given]
        return self.spark.createDataFrame(data, ", ".join(f"`{c.name}` {t}" for c, t in zip(columns, types)) or "__none int")

    def insert_frame(self, given: DataFrame, returning: bool = False):
        entity = self.entity
        full = writes.stamped(entity, given, self.now(), self.options.user, True)
        # keys that are all made are new ones, so the table's need not be read
        made = all((k.generated or k.sequential_guid) and k.name not in given.columns for k in entity.keys)
        found = self.changeable().append(entity, full, lambda rows: None if made else writes.new_keys(entity, self.rows(), rows), returning)
        if not returning or found is None:
            return found
        return reads.shown(self.spark.createDataFrame([found], full.schema), entity, None).first()

    def key_write(self, keys: tuple, values: dict[str, Any]) -> SparkColumn:
        """Key, token if the entity has one, and the filters enforced on writes."""
        parts = [reads.key_condition(self.entity, keys)]
        for c in self.entity.columns.values():
            if c.token:
                if c.name not in values:
                    raise StoreError(f"{c.name} must be given: a row with a token is written with it")
                parts.append(F.col(c.name) == c.stored(values[c.name]))
        own = enforced(self.entity)
        return all_of(parts + ([own] if own is not None else []))

    def removal(self, hard: bool):
        """What becomes of marked rows: flagged as deleted, or gone."""
        sets = writes.deletion(self.entity, self.now()) if self.soft and not hard else None
        return writes.without if sets is None else lambda df: writes.with_set(self.entity, df, sets)

    def lost(self, result):
        if self.options.throw_on_conflict and any(c.token for c in self.entity.columns.values()):
            raise ConcurrencyConflict(f"{self.entity.__name__}: the row is gone or has changed")
        return result
