"""Declared stores: definition errors, reads, pages, filters, relations."""

from datetime import datetime
from enum import Enum

import pytest

from quern import AdHoc, BelongsTo, Column, Compare, DefinitionError, Entity, FilterValueMissing, FrameTables, GlobalFilter, HasMany, ManyToMany, Projection, Store, StoreError, Where, filter_scope
from quern.functions import predicates
from quern.operators import adhoc
from quern.plans import schema
from quern.plans.hooks import Hooks, RepeatedReads, SlowOperations
from quern.plans.store import (
    Aggregate, Count, DeleteWhere, Exists, FullTextSearch, GroupCount, Insert, KeysetPage, PagedResult, Restore, SelectAll, SelectAllByField, SelectAllEager, SelectByPredicate, SelectOneByKey,
    SelectOneEager, SelectRelated, TopByOrder, UpdateWhere, Upsert, named_fields,
)
from quern.streaming import stream_rows


class Category(Entity, table="category"):
    id = Column("int", key=True)
    name = Column("string")
    products = HasMany(lambda: Product, "category_id")


class Product(Entity, table="product"):
    id = Column("int", key=True)
    name = Column("string")
    price = Column("decimal")
    category_id = Column("int", references="category.id")
    deleted = Column("bool", nullable=False, soft_delete=True)
    data = Column("json")
    label = Column("string", computed="concat(name, '#', id)")
    category = BelongsTo(lambda: Category, "category_id")
    tags = ManyToMany(lambda: Tag)


class Tag(Entity, table="tag"):
    id = Column("int", key=True)
    slug = Column("string")


class Doc(Entity, table="doc"):
    id = Column("int", key=True)
    tenant = Column("long", filter=GlobalFilter(context_key="tenant", enforce_on_writes=True))
    published = Column("bool", filter=GlobalFilter(name="published"))
    deleted_at = Column("datetime", soft_delete=True)


class NameOnly(Projection, entity=Product, fields=("id", "name")):
    pass


class CategoryView(Entity, table="product", view=True):
    category_id = Column("int")


class Products(Store, entity=Product):
    all = SelectAll(order_by="id")
    everything = SelectAll(include_deleted=True, order_by="id")
    names = SelectAll(projection=NameOnly, order_by="price DESC, id")
    pages = SelectAll(order_by="id", paged=True)
    by_key = SelectOneByKey()
    find_by_category_id_and_name = SelectAllByField()
    in_category = SelectAllByField("category_id")
    counted = PagedResult("category_id", order_by="id")
    cheap_or_named = SelectByPredicate(Where("price", Compare.LESS), Where("category_id"), Where("name", Compare.LIKE, or_=True))
    between = SelectByPredicate(Where("price", Compare.BETWEEN))
    outside = SelectByPredicate(Where("price", Compare.NOT_BETWEEN))
    ids_in = SelectByPredicate(Where("category_id", Compare.IN))
    ids_not_in = SelectByPredicate(Where("category_id", Compare.NOT_IN))
    not_like = SelectByPredicate(Where("name", Compare.NOT_LIKE))
    orphans = SelectByPredicate(Where("category_id", Compare.IS_NULL))
    colour = SelectByPredicate(Where("data", json_path="$.a.colour"))
    top = TopByOrder("price", descending=True)
    keyset = KeysetPage("price", "id")
    back = KeysetPage("id", descending=True)
    n = Count()
    any = Exists(Where("name"))
    total = Aggregate("sum", "price")
    groups = GroupCount("category_id")
    search = FullTextSearch("name", "label")
    eager = SelectAllEager("category", "tags")
    one_eager = SelectOneEager("tags")
    own_tags = SelectRelated("tags")


class Categories(Store, entity=Category):
    eager = SelectAllEager("products")
    children = SelectRelated("products")


class Docs(Store, entity=Doc):
    all = SelectAll(order_by="id")
    drafts = SelectAll(order_by="id", ignore_filters=("published",))
    deleted = SelectAll(order_by="id", include_deleted=True)
    n = Count()


@pytest.fixture(scope="module")
def tables(spark):
    product = spark.createDataFrame(
        [(1, "Chai", 18, 1, False, '{"a": {"colour": "red"}}'), (2, "Chang", 19, 1, False, None), (3, "Aniseed", 10, 2, False, '{"a": 1}'), (4, "Cheese", 21, None, False, "broken"), (5, "Chef mix", 19, 9, True, None)],
        "id int, name string, price int, category_id int, deleted boolean, data string",
    ).withColumn("price", predicates.F.col("price").cast("decimal(18,2)"))
    now = datetime(2024, 1, 1)
    frames = {
        "product": product,
        "category": spark.createDataFrame([(1, "Drinks"), (2, "Spices"), (3, "Empty")], "id int, name string"),
        "tag": spark.createDataFrame([(1, "hot"), (2, "cold")], "id int, slug string"),
        "product_tag": spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (5, 1), (3, 7)], "product_id int, tag_id int"),
        "doc": spark.createDataFrame([(1, 7, True, None), (2, 7, False, None), (3, 8, True, None), (4, 7, True, now)], "id int, tenant long, published boolean, deleted_at timestamp_ntz"),
    }
    return FrameTables(spark, frames)


@pytest.fixture(scope="module")
def products(tables):
    return Products(tables)


def ids(df):
    return [r.id for r in df.collect()]


def test_selects(products):
    assert ids(products.all()) == [1, 2, 3, 4] and ids(products.everything()) == [1, 2, 3, 4, 5]
    assert [tuple(r) for r in products.names().collect()] == [(4, "Cheese"), (2, "Chang"), (1, "Chai"), (3, "Aniseed")]
    assert products.by_key(1).first().label == "Chai#1" and products.by_key(5).count() == 0
    assert ids(products.find_by_category_id_and_name(1, "Chai")) == [1] and ids(products.in_category(None)) == []
    assert products.top().first().id == 4


def test_predicates(products):
    assert sorted(ids(products.cheap_or_named(19, 1, "Chee%"))) == [1, 4]
    assert sorted(ids(products.between(10, 18))) == [1, 3] and sorted(ids(products.outside(10, 18))) == [2, 4]
    assert ids(products.ids_in([])) == ids(products.ids_in(None)) == [] and sorted(ids(products.ids_in([1, 1]))) == [1, 2]
    assert sorted(ids(products.ids_not_in([]))) == [1, 2, 3, 4] and ids(products.ids_not_in([1, None])) == [] and ids(products.ids_not_in([1])) == [3]
    assert ids(products.not_like("Ch%")) == [3] and ids(products.orphans()) == [4] and ids(products.colour("red")) == [1]
    with pytest.raises(StoreError):
        products.between(1)


def test_long_lists_are_joined(products):
    many = list(range(-2000, 2))
    assert sorted(ids(products.ids_in(many))) == [1, 2] and ids(products.ids_not_in(many)) == [3]
    plan = products.ids_in(many)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_backslashes_are_plain_in_patterns(tables):
    frame = tables.spark.createDataFrame([(1, "a\\b"), (2, "a%b"), (3, "ab")], "id int, name string")
    products = Products(FrameTables(tables.spark, {"product": frame.selectExpr("id", "name", "cast(1 as decimal(18,2)) price", "1 category_id", "false deleted", "'' data")}))
    assert ids(products.not_like("a\\b")) == [2, 3] and ids(products.not_like("%\\")) == [1, 2, 3] and ids(products.not_like("a\\%b")) == [2, 3]


def test_keyset_passes_over_nulls(tables):
    rows = [(i, f"p{i}", None if i % 3 == 0 else i) for i in range(1, 10)]
    frame = tables.spark.createDataFrame(rows, "id int, name string, price int").selectExpr("id", "name", "cast(price as decimal(18,2)) price", "1 category_id", "false deleted", "'' data")
    products = Products(FrameTables(tables.spark, {"product": frame}))
    seen, cursor = [], None
    while True:
        page = products.keyset(cursor, 2)
        seen += [r.id for r in page.items]
        cursor = page.next_cursor
        if not page.has_more:
            break
    assert seen == [3, 6, 9, 1, 2, 4, 5, 7, 8]


def test_pages(products):
    assert ids(products.pages(1, 2)) == [2, 3] and ids(products.pages(3, 9)) == [4] and ids(products.pages(9, 1)) == []
    for bad in ((-1, 1), (0, 0)):
        with pytest.raises(StoreError):
            products.pages(*bad)
    page = products.counted(1, 0, 1)
    assert [r.id for r in page.items] == [1] and page.total == 2
    first = products.keyset(None, 2)
    assert [r.id for r in first.items] == [3, 1] and first.has_more
    second = products.keyset(first.next_cursor, 2)
    assert [r.id for r in second.items] == [2, 4] and not second.has_more and second.next_cursor is None
    assert [r.id for r in products.back((3,), 5).items] == [2, 1]
    for size in (0, 2**31 - 1):
        with pytest.raises(StoreError):
            products.keyset(None, size)


def test_aggregates(products, tables):
    assert products.n().first()[0] == 4 and products.any("Chai").first()[0] and not products.any("Chef mix").first()[0]
    assert products.total().first()[0] == 68
    assert {(r.key, r["count"]) for r in products.groups().collect()} == {(1, 2), (2, 1), (None, 1)}
    none = Products(FrameTables(tables.spark, {"product": tables.frames["product"].limit(0)}))
    assert none.total().first()[0] is None and none.groups().count() == 0 and none.top().count() == 0 and none.n().first()[0] == 0


def test_search(products):
    assert ids(products.search("CHAI")) == [1] and ids(products.search("chai 1")) == [1] and ids(products.search("cha")) == [] and ids(products.search(" ")) == []


def test_eager(products, tables):
    rows = {r.id: r for r in products.eager().collect()}
    assert [t.slug for t in rows[1].tags] == ["hot", "cold", "cold"] and rows[3].tags == [] and rows[4].category is None and rows[2].category.name == "Drinks"
    assert [t.id for t in products.one_eager(2).first().tags] == [1]
    parents = {r.id: [p.id for p in r.products] for r in Categories(tables).eager().collect()}
    assert parents == {1: [1, 2], 2: [3], 3: []}
    assert sorted(ids(Categories(tables).children(1))) == [1, 2] and sorted(ids(products.own_tags(1))) == [1, 2, 2]
    flat = Categories.eager.flat(Categories(tables), "products")
    assert sorted((r.id, r.products_id or 0) for r in flat.collect()) == [(1, 1), (1, 2), (2, 3), (3, 0)]


def test_filters_and_scopes(tables):
    docs = Docs(tables)
    with pytest.raises(FilterValueMissing):
        docs.all()
    with filter_scope(tenant=7):
        lazy = docs.all()
        assert ids(docs.drafts()) == [1, 2] and ids(docs.deleted()) == [1, 4]
        with filter_scope(other=1), pytest.raises(FilterValueMissing):
            docs.n()
        with filter_scope(tenant="7"), pytest.raises(FilterValueMissing):
            docs.n()
    with filter_scope(tenant=8):
        assert ids(lazy) == [1] and ids(docs.all()) == [3]  # a frame keeps the values of its call


@pytest.mark.parametrize(
    "entity, operation, code",
    [
        (Product, lambda: SelectAll(paged=True), "page-without-order"), (Product, lambda: SelectAll(order_by="id UP"), "order-syntax"), (Product, lambda: SelectAll(order_by="no"), "no-column"), (Product, lambda: SelectAll(lock="update"), "no-row-locks"),
        (Product, lambda: SelectAll(ignore_filters=("x",)), "no-filter-of-that-name"), (Product, lambda: SelectByPredicate(Where("price", Compare.LIKE)), "pattern-on-no-text"), (Product, lambda: SelectByPredicate(Where("data", json_path="a.b")), "json-path-syntax"),
        (Product, lambda: Aggregate("sum", "name"), "aggregate-of-no-number"), (Product, lambda: FullTextSearch("price"), "search-in-no-text"), (Product, lambda: SelectAllEager("no"), "no-relation"), (Doc, lambda: Upsert(), "upsert-past-filter"), (Category, lambda: Restore(), "nothing-to-restore"),
        (Product, lambda: UpdateWhere(("id",), Where("name")), "column-not-settable"), (Product, lambda: UpdateWhere(("name",)), "no-criterion"), (Product, lambda: DeleteWhere(), "no-criterion"), (CategoryView, lambda: Insert(), "view-is-read-only"), (CategoryView, lambda: SelectOneByKey(), "no-key-to-find-by"),
        (Product, lambda: PagedResult("name", order_by="id", distinct=True), "total-of-distinct"), (Product, lambda: SelectAllByField(), "no-fields"),
    ],
)
def test_wrong_stores_are_refused_when_defined(entity, operation, code):
    with pytest.raises(DefinitionError) as e:
        type("S", (Store,), {"op": operation()}, entity=entity)
    assert e.value.code == code


def test_wrong_entities_are_refused():
    for code, columns in {"no-type": {"a": Column("nothing", key=True)}, "no-key": {"a": Column("int")}, "generated-key-type": {"a": Column("string", key=True, generated=True)}, "deletion-mark-type": {"a": Column("int", key=True), "b": Column("int", soft_delete=True)}, "role-twice": {"a": Column("int", key=True), "b": Column("int", token=True), "c": Column("int", token=True)}}.items():
        with pytest.raises(DefinitionError) as e:
            type("Bad", (Entity,), columns)
        assert e.value.code == code


def test_names_and_schema():
    assert named_fields("find_by_a_and_b") == ["a", "b"] and named_fields("FindByCountryAndCityAsync") == ["Country", "City"] and named_fields("all") == []
    assert schema.creation_order([Product, Category]) == [Category, Product]
    text = schema.ddl(Product)
    assert "`price` DECIMAL(18,2)" in text and "`id` INT NOT NULL" in text and "quern.references.category_id" in text
    a = type("A", (Entity,), {"id": Column("int", key=True), "b": Column("int", references="B.id")})
    b = type("B", (Entity,), {"id": Column("int", key=True), "a": Column("int", references="A.id")})
    assert schema.rings([a, b]) == [{"A", "B"}] and len(schema.creation_order([a, b])) == 2
    assert '"name": "category"' in schema.manifest([Product, Category])


def test_ad_hoc(spark, products):
    class Pair(AdHoc, fields=("x", "y")):
        pass

    assert adhoc.query(spark, "select :a, :b", Pair, a=1, b="q'").first().asDict() == {"x": 1, "y": "q'"}
    assert adhoc.scalar(adhoc.query(spark, "select null"), 5) == 5 and adhoc.single_or_none(spark.range(0)) is None
    with pytest.raises(StoreError):
        adhoc.single_or_none(spark.range(2))
    assert [d.first()[0] for d in adhoc.several(spark, "select 1", "select :v", v=2)] == [1, 2]
    p = adhoc.Procedures()
    p.register("double")(lambda s, n: s.range(n * 2))
    assert p.call(spark, "DOUBLE", n=2).count() == 4
    with pytest.raises(StoreError):
        p.call(spark, "other")
    p.register("count", outputs=("total", "n"))(lambda s, rows, n: adhoc.Outcome((rows, s.range(n)), {"total": rows.count(), "n": n + 1}, 0))
    got = p.call(spark, "count", rows=spark.range(3), n=2)
    assert [f.count() for f in got.frames] == [3, 2] and got.outputs == {"total": 3, "n": 3} and got.returned == 0
    p.register("silent", outputs=("total",))(lambda s: None)
    with pytest.raises(StoreError):
        p.call(spark, "silent")
    kind = Enum("Kind", {"A": 7})
    assert adhoc.query(spark, "select :a, :b", a=kind.A, b=2**63 + 1).first()[:] == (7, 2**63 + 1)


def test_hooks_and_streams(tables):
    slow, repeated, events = SlowOperations(0), RepeatedReads(2), []
    products = Products(tables, hooks=Hooks([slow, repeated, lambda e: events.append(e.stage)]))
    products.by_key(1)
    products.by_key(2)
    with pytest.raises(StoreError):
        products.between(1)
    assert events == ["initialized", "executing", "executed"] * 2 + ["initialized", "executing", "failed"]
    assert repeated.suspects == [("Products", "by_key")] and len(slow.found) == 3
    assert "id#" in slow.found[0].plan and slow.found[0].result.count() == 1 and slow.found[2].plan is None
    assert [r.id for r in stream_rows(products.all())] == [1, 2, 3, 4]
