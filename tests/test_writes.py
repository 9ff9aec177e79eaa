"""Changes over written and planned states: filters on writes, keys, tokens, stamps."""

from datetime import datetime
from enum import Enum

import pytest
from pyspark.sql import functions as F

from quern import Column, Compare, ConcurrencyConflict, Converter, Entity, FilterValueMissing, FrameTables, GlobalFilter, StateTables, Store, StoreError, Where, as_json, as_name, filter_scope
from quern.plans.store import (
    BulkInsert, Delete, DeleteAll, DeleteWhere, Execute, Insert, InsertAll, Options, Restore, SelectAll, Update, UpdateAll, UpdateWhere, Upsert,
)


class Item(Entity, table="item"):
    id = Column("long", key=True, generated=True)
    name = Column("string")
    amount = Column("decimal")
    deleted = Column("bool", nullable=False, soft_delete=True)
    created_at = Column("datetime", audit="created_at")
    modified_by = Column("string", audit="modified_by")
    shout = Column("string", computed="upper(name)")


class Versioned(Entity, table="versioned"):
    id = Column("int", key=True)
    title = Column("string", converter=Converter(F.reverse, F.reverse))
    version = Column("int", token=True)


class Owned(Entity, table="owned"):
    id = Column("int", key=True)
    tenant = Column("long", filter=GlobalFilter(context_key="tenant", enforce_on_writes=True))
    visible = Column("bool", filter=GlobalFilter())
    title = Column("string")
    gone_at = Column("datetime", soft_delete=True)


class Guided(Entity, table="guided"):
    id = Column("guid", key=True, sequential_guid=True)
    name = Column("string")


class Colour(Enum):
    RED = 1
    BLUE = 2


class Plain(Entity, table="plain"):
    id = Column("int", key=True)
    name = Column("string")


class Renamed(Entity, table="renamed"):
    id = Column("int", name="the_id", key=True)
    name = Column("string", name="the_name")


class Shaped(Entity, table="shaped"):
    id = Column("int", key=True)
    colour = Column("string", converter=as_name(Colour))
    detail = Column("string", converter=as_json("struct<n:int>"))


class PlainStore(Store, entity=Plain):
    all = SelectAll(order_by="id")
    add = Insert()
    add_all = InsertAll()
    put = Upsert()
    erase_in = DeleteWhere(Where("id", Compare.IN), hard=True)
    erase_not_in = DeleteWhere(Where("id", Compare.NOT_IN), hard=True)
    rename_in = UpdateWhere(("name",), Where("id", Compare.IN))
    run = Execute("name = :name")
    mark = Execute("id >= :least", name="concat(name, :mark)")


class RenamedStore(Store, entity=Renamed):
    all = SelectAll(order_by="the_id")
    add = Insert()
    change = Update()


class ShapedStore(Store, entity=Shaped):
    all = SelectAll(order_by="id")
    add = Insert()
    add_all = InsertAll()
    change = Update()


class Items(Store, entity=Item):
    all = SelectAll(include_deleted=True, order_by="id")
    active = SelectAll(order_by="id")
    add = Insert()
    add_returning = Insert(returning=True)
    add_all = InsertAll()
    bulk = BulkInsert()
    change = Update()
    change_all = UpdateAll()
    rename = UpdateWhere(("name",), Where("amount", Compare.GREATER))
    put = Upsert()
    drop = Delete()
    erase = Delete(hard=True)
    drop_all = DeleteAll()
    erase_where = DeleteWhere(Where("amount", Compare.LESS), hard=True)
    drop_where = DeleteWhere(Where("amount", Compare.LESS))
    restore = Restore()


class VersionedStore(Store, entity=Versioned):
    all = SelectAll(order_by="id")
    change = Update()
    change_returning = Update(returning=True)
    drop = Delete()


class OwnedStore(Store, entity=Owned):
    change = Update()
    drop = Delete()
    drop_where = DeleteWhere(Where("title"))
    erase_where = DeleteWhere(Where("title"), hard=True)
    restore = Restore()


class OwnedSeeds(Store, entity=Owned):
    add_all = InsertAll()


class GuidStore(Store, entity=Guided):
    add_all = InsertAll()


@pytest.fixture
def tables(spark, tmp_path):
    t = StateTables(spark, folder=str(tmp_path / "store"))
    now = datetime(2020, 1, 1)
    rows = [(1, "a", 5, False, now, "x", "A"), (2, "b", 15, False, now, "x", "B"), (3, "c", None, True, now, "x", "C")]
    t.create(Item, spark.createDataFrame(rows, "id long, name string, amount int, deleted boolean, created_at timestamp_ntz, modified_by string, shout string").repartition(3, "id"))
    t.create(Versioned, spark.createDataFrame([(1, "eno", 0)], "id int, title string, version int"))
    t.create(Owned, spark.createDataFrame([(1, 7, True, "t", None), (2, 8, True, "t", None), (3, 7, False, "t", None)], "id int, tenant long, visible boolean, title string, gone_at timestamp_ntz"))
    t.create(Guided, spark.createDataFrame([], "id string, name string"))
    return t


@pytest.fixture
def items(tables):
    return Items(tables, Options(user="me"))


def names(df):
    return [(r.id, r.name) for r in df.collect()]


def test_inserts(items):
    assert items.add(name="d", amount=1) == 1
    stored = items.add_returning(name="e", amount=2)
    assert (stored.id, stored.shout, stored.deleted, stored.modified_by) == (5, "E", False, "me") and stored.created_at.year >= 2024
    assert items.add_all([]) == 0 and items.add_all([{"name": "f", "amount": 1}, {"name": "g"}]) == 2
    assert items.bulk(items.spark.range(5).select(F.concat(F.lit("n"), "id").alias("name"))) == 5
    assert [r.id for r in items.all().collect()] == list(range(1, 13))


def test_updates(items):
    assert items.change(id=1, name="aa") and not items.change(id=99, name="zz")
    row = items.all().first()
    assert (row.name, row.shout, row.modified_by, row.created_at.year, row.amount) == ("aa", "AA", "me", 2020, 5)
    assert items.change_all([{"id": 1, "name": "x"}, {"id": 3, "name": "y"}, {"id": 77, "name": "n"}]) == 2
    assert names(items.all()) == [(1, "x"), (2, "b"), (3, "y")]
    with pytest.raises(StoreError):
        items.change_all([{"id": 1, "name": "x"}, {"id": 1, "name": "y"}])
    assert items.rename("big", 10) == 1 and names(items.active()) == [(1, "x"), (2, "big")]


def test_deletes_and_restore(items):
    assert items.drop(1) and items.drop(1)  # by key, a deleted row is found again
    assert names(items.active()) == [(2, "b")] and items.restore(1) and names(items.active()) == [(1, "a"), (2, "b")]
    assert items.drop_where(10) == 1 and items.drop_where(10) == 0  # by predicate it is not
    assert items.drop_all([2, 99]) == 1 and items.drop_all([]) == 0 and items.active().count() == 0
    assert items.erase_where(10) == 1 and [r.id for r in items.all().collect()] == [2, 3]  # unknown amounts stay
    assert items.erase(3) and not items.erase(3)


def test_upsert(items):
    assert items.put([{"id": 2, "name": "bb", "amount": 1}, {"id": 8, "name": "new"}, {"id": None, "name": "fresh"}]) == 3
    got = {r.id: r for r in items.all().collect()}
    assert got[2].name == "bb" and got[2].created_at.year == 2020 and got[8].created_at.year >= 2024 and sorted(got) == [1, 2, 3, 8, 9]


def test_tokens_and_converters(tables):
    store = VersionedStore(tables)
    assert store.all().first().title == "one"
    assert store.change(id=1, title="two", version=0) and not store.change(id=1, title="three", version=0)
    assert (store.all().first().title, store.all().first().version) == ("two", 1)
    assert store.change_returning(id=1, title="x", version=9) is None
    with pytest.raises(StoreError):
        store.drop(1)
    with pytest.raises(ConcurrencyConflict):
        VersionedStore(tables, Options(throw_on_conflict=True)).drop(1, version=0)
    assert store.drop(1, version=1) and store.all().count() == 0


def test_filters_on_writes(tables):
    store = OwnedStore(tables)
    with pytest.raises(FilterValueMissing):
        store.drop(1)
    with filter_scope(tenant=7):
        assert not store.change(id=2, title="n") and store.change(id=3, title="n")  # a hidden row can be written by key
        assert store.drop_where("t") == 1 and store.restore(1) and not store.restore(2)
        assert store.erase_where("n") == 1


def test_guids_grow(tables):
    GuidStore(tables).add_all([{"name": "a"}, {"name": "b"}])
    rows = tables.frame(Guided).collect()
    assert len({r.id for r in rows}) == 2 and all(len(r.id) == 36 and r.id[14] == "7" for r in rows)


def test_keys_stay_unique(items, tables):
    """A key that is there, or twice in a batch, is refused, and nothing is changed."""
    store = PlainStore(StateTables(tables.spark, FrameTables(tables.spark, {"plain": tables.spark.createDataFrame([(1, "a")], "id int, name string")})))
    for wrong in (lambda: store.add(id=1, name="b"), lambda: store.add_all([{"id": 5}, {"id": 5}]), lambda: store.add_all([{"id": 1}]), lambda: store.add(name="no key"), lambda: store.put([{"id": 8, "name": "x"}, {"id": 8, "name": "y"}]), lambda: items.put([{"id": 2, "name": "x"}, {"id": 2, "name": "y"}])):
        with pytest.raises(StoreError):
            wrong()
    assert names(store.all()) == [(1, "a")] and items.all().count() == 3
    assert store.put([{"id": 1, "name": "aa"}, {"id": 2, "name": "b"}]) == 2 and names(store.all()) == [(1, "aa"), (2, "b")]


def test_unknown_columns_are_refused(items):
    for wrong in (lambda: items.change(id=1, nmae="typo"), lambda: items.add(nmae="typo"), lambda: items.add_all([{"name": "a", "nmae": "b"}]), lambda: items.change(name="no key"), lambda: items.bulk(items.spark.range(2).toDF("nmae"))):
        with pytest.raises(StoreError):
            wrong()
    assert [r.name for r in items.all().collect()] == ["a", "b", "c"]


def test_long_lists_in_writes(tables):
    frames = FrameTables(tables.spark, {"plain": tables.spark.range(3000).selectExpr("cast(id as int) id", "cast(id as string) name")})
    store = PlainStore(StateTables(tables.spark, frames))
    assert store.erase_in(list(range(1, 3000, 2))) == 1500 and store.all().count() == 1500
    assert store.rename_in("even", list(range(0, 2004, 2))) == 1002 and store.all().where("name = 'even'").count() == 1002
    assert store.erase_not_in([None, *range(2000)]) == 0 and store.erase_not_in(list(range(2000))) == 500


def test_attributes_stand_for_columns(tables):
    store = RenamedStore(StateTables(tables.spark, FrameTables(tables.spark, {"renamed": tables.spark.createDataFrame([(1, "a")], "the_id int, the_name string")})))
    assert store.change(id=1, name="b") and [tuple(r) for r in store.all().collect()] == [(1, "b")]
    assert store.add(id=2, the_name="c") == 1 and store.all().count() == 2


def test_enums_and_json_are_converted(tables):
    store = ShapedStore(StateTables(tables.spark, FrameTables(tables.spark, {"shaped": tables.spark.createDataFrame([], "id int, colour string, detail string")})))
    assert store.add(id=1, colour=Colour.RED, detail={"n": 1}) == 1 and store.add_all([{"id": 2, "colour": "BLUE", "detail": None}]) == 1
    assert [(r.id, r.colour, r.detail and r.detail.n) for r in store.all().collect()] == [(1, "RED", 1), (2, "BLUE", None)]
    assert store.change(id=2, detail={"n": 7}) and store.all().collect()[1].detail.n == 7
    assert [r.colour for r in store.rows().orderBy("id").collect()] == ["RED", "BLUE"]
    with pytest.raises(KeyError):
        store.add(id=3, colour="GREEN")


def test_execute_binds_and_counts(tables):
    store = PlainStore(StateTables(tables.spark, FrameTables(tables.spark, {"plain": tables.spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string")})))
    assert store.run(name="x' or true") == 0 and store.run(name="b") == 1
    assert store.mark(least=2, mark="!") == 1 and names(store.all()) == [(1, "a"), (3, None)]


def test_states_are_written_once_and_inserts_add_files(items, tmp_path):
    def files():
        return {p for p in (tmp_path / "store" / "item").rglob("*.parquet")}

    before = files()
    items.add(name="q")
    assert before < files()  # the files that were there are as they were
    state = items.tables._numbers(Item)
    assert items.change(id=99, name="z") is False and items.tables._numbers(Item) == state
    assert items.change(id=1, name="z") and len(items.tables._numbers(Item)) == len(state) + 1
    again = Items(StateTables(items.spark, folder=str(tmp_path / "store")))
    assert names(again.all()) == names(items.all())


def test_read_only_tables_and_made_keys(tables):
    frames = FrameTables(tables.spark, {"plain": tables.spark.createDataFrame([(1, "a")], "id int, name string")})
    with pytest.raises(StoreError):
        PlainStore(frames).add(id=2)
    with pytest.raises(StoreError):  # keys that are made need rows that are written
        Items(StateTables(tables.spark, FrameTables(tables.spark, {"item": tables.frame(Item)}))).add(name="x")


def test_times_are_taken_as_written(spark, tables, monkeypatch):
    from quern.functions.values import literal

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert spark.range(1).select(literal(datetime(2024, 1, 2, 3), "timestamp_ntz").alias("t")).first().t == datetime(2024, 1, 2, 3)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_seeders_run_in_order_and_add_what_is_missing(items, tables):
    from quern.plans.seeding import Seeders, seed

    seeders = Seeders()

    @seeders.register(order=2)
    def later(t):
        seed(OwnedSeeds(t), [{"id": 9, "title": "nine"}])

    @seeders.register(order=1)
    def first(t):
        seed(OwnedSeeds(t), t.spark.createDataFrame([(1, "kept"), (8, "eight")], "id int, title string"))

    @seeders.register(order=1)
    def also(t):
        assert seed(OwnedSeeds(t), [{"id": 8, "title": "again"}]) == 0

    for _ in range(2):
        assert seeders.run(tables) == ["first", "also", "later"]
    assert [(r.id, r.title) for r in tables.frame(Owned).orderBy("id").collect()] == [(1, "t"), (2, "t"), (3, "t"), (8, "eight"), (9, "nine")]
