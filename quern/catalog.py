"""The query catalogue: one query for each operation, over the driver's tables, and the SQL that it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.filters import GlobalFilter, filter_scope
from .functions.predicates import Compare, Where
from .operators import adhoc, relations
from .plans import store as s
from .sources.entity import AdHoc, BelongsTo, Column, Converter, Entity, HasMany, ManyToMany, Projection, as_json, as_name
from .sources.shared import shared_dir
from .sources.states import StateTables
from .sources.tables import FrameTables, ParquetTables
from .streaming import stream_rows


class Region(Entity, table="region"):
    r_regionkey = Column("int", key=True)
    r_name = Column("string")
    nations = HasMany(lambda: Nation, "n_regionkey")


class Nation(Entity, table="nation"):
    n_nationkey = Column("int", key=True)
    n_name = Column("string")
    n_regionkey = Column("int", references="region.r_regionkey")
    region = BelongsTo(lambda: Region, "n_regionkey")
    customers = HasMany(lambda: Customer, "c_nationkey")


class Customer(Entity, table="customer"):
    c_custkey = Column("long", key=True)
    c_name = Column("string")
    c_nationkey = Column("int", references="nation.n_nationkey")
    c_acctbal = Column("double")
    c_mktsegment = Column("string")
    nation = BelongsTo(lambda: Nation, "c_nationkey")


class Order(Entity, table="orders"):
    o_orderkey = Column("long", key=True)
    o_custkey = Column("long", references="customer.c_custkey")
    o_orderstatus = Column("string")
    o_totalprice = Column("double")
    o_orderdate = Column("datetime")
    o_orderpriority = Column("string")
    customer = BelongsTo(lambda: Customer, "o_custkey")
    lines = HasMany(lambda: Line, "l_orderkey")


class Part(Entity, table="part"):
    p_partkey = Column("long", key=True)
    p_name = Column("string")
    p_brand = Column("string")
    p_type = Column("string")
    p_size = Column("int")
    p_retailprice = Column("double")


class Line(Entity, table="lineitem", view=True):
    l_orderkey = Column("long")
    l_partkey = Column("long")
    l_suppkey = Column("long")
    l_linenumber = Column("int")
    l_quantity = Column("double")
    l_extendedprice = Column("double")
    l_discount = Column("double")
    l_tax = Column("double")
    l_returnflag = Column("string")
    l_linestatus = Column("string")


class OrderParts(Order, table="orders"):
    """Orders with their parts through their lines."""

    o_orderkey = Column("long", key=True)
    o_orderpriority = Column("string")
    parts = ManyToMany(Part, junction=Line, parent_key="l_orderkey", child_keys=("l_partkey",))


class Event(Entity, table="events"):
    event_id = Column("long", key=True)
    ts = Column("datetime")
    user_id = Column("long")
    event_type = Column("string")
    value = Column("double")
    props = Column("json")


class Turn(Entity, table="conversations"):
    conv_id = Column("long", key=True)
    turn = Column("long", key=True)
    role = Column("string")
    text = Column("string")


class Document(Entity, table="documents"):
    doc_id = Column("long", key=True)
    text = Column("string")
    lang = Column("string")
    source = Column("string")


# entities whose flags are made from the tables' columns

class SoftOrder(Entity, table="soft_orders"):
    o_orderkey = Column("long", key=True)
    o_custkey = Column("long")
    o_totalprice = Column("double")
    o_orderpriority = Column("string")
    o_deleted = Column("bool", nullable=False, soft_delete=True)
    o_open = Column("bool", filter=GlobalFilter(name="open"))
    o_version = Column("int", token=True)


class TenantCustomer(Entity, table="customer"):
    c_custkey = Column("long", key=True)
    c_name = Column("string")
    c_nationkey = Column("int", filter=GlobalFilter(context_key="nation", enforce_on_writes=True))
    c_acctbal = Column("double")


class NullableOrder(Entity, table="nullable_orders"):
    """Orders without a customer where their priority is medium, and without a price while they are open."""

    o_orderkey = Column("long", key=True)
    o_custkey = Column("long")
    o_totalprice = Column("double")


class LabelledPart(Entity, table="part"):
    p_partkey = Column("long", key=True)
    p_brand = Column("string", converter=Converter(lambda c: F.concat(F.lit("Brand#"), c), lambda c: F.replace(c, F.lit("Brand#"), F.lit(""))))
    p_label = Column("string", computed="concat(p_name, ' / ', p_type)")
    p_name = Column("string")
    p_type = Column("string")


class OrderSummary(Projection, entity=Order, fields=("o_orderkey", "o_totalprice")):
    pass


class SoftOrderName(Projection, entity=SoftOrder, fields=("o_orderkey", "o_orderpriority")):
    pass


class CustomerOrderStatus(Projection, entity=Order, fields=("o_orderstatus", "o_orderpriority")):
    pass


SOFT = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus = 'F' AS o_deleted, o_orderpriority <> '1-URGENT' AS o_open, CAST(o_custkey % 5 AS INT) AS o_version FROM orders"
NULLS = "SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders"


class Orders(s.Store, entity=Order):
    all = s.SelectAll()
    statuses = s.SelectAll(projection=CustomerOrderStatus, distinct=True)
    ordered_statuses = s.SelectAll(projection=CustomerOrderStatus, distinct=True, order_by="o_orderstatus, o_orderpriority DESC", paged=True)
    latest = s.SelectAll(order_by="o_orderdate DESC, o_orderkey ASC", paged=True)
    one = s.SelectOneByKey()
    of_customer = s.SelectAllByField("o_custkey", "o_orderstatus")
    find_by_o_orderstatus_and_o_orderpriority = s.SelectAllByField()
    summaries = s.SelectAll(projection=OrderSummary)
    dearest = s.TopByOrder("o_totalprice", descending=True)
    by_price = s.KeysetPage("o_totalprice", "o_orderkey")
    by_key = s.KeysetPage("o_orderkey")
    by_price_back = s.KeysetPage("o_totalprice", "o_orderkey", descending=True)
    paged = s.PagedResult("o_orderstatus", order_by="o_orderkey")
    equal = s.SelectByPredicate(Where("o_orderstatus"), Where("o_orderpriority", Compare.NOT_EQUAL))
    prices = s.SelectByPredicate(Where("o_totalprice", Compare.GREATER_OR_EQUAL), Where("o_totalprice", Compare.LESS), Where("o_orderkey", Compare.GREATER), Where("o_orderkey", Compare.LESS_OR_EQUAL))
    like = s.SelectByPredicate(Where("o_orderpriority", Compare.LIKE))
    not_like = s.SelectByPredicate(Where("o_orderpriority", Compare.NOT_LIKE))
    flat_or = s.SelectByPredicate(Where("o_totalprice", Compare.LESS), Where("o_orderstatus"), Where("o_orderpriority", or_=True), Where("o_custkey", Compare.LESS))
    n = s.Count()
    any_dear = s.Exists(Where("o_totalprice", Compare.GREATER))
    total = s.Aggregate("sum", "o_custkey")
    mean = s.Aggregate("avg", "o_totalprice")
    least = s.Aggregate("min", "o_totalprice")
    most = s.Aggregate("max", "o_orderdate")
    groups = s.GroupCount("o_orderpriority")
    change_all = s.UpdateAll()


class NullableOrders(s.Store, entity=NullableOrder):
    between = s.SelectByPredicate(Where("o_totalprice", Compare.BETWEEN))
    outside = s.SelectByPredicate(Where("o_totalprice", Compare.NOT_BETWEEN))
    null = s.SelectByPredicate(Where("o_custkey", Compare.IS_NULL), Where("o_totalprice", Compare.IS_NOT_NULL))
    listed = s.SelectByPredicate(Where("o_custkey", Compare.IN))
    unlisted = s.SelectByPredicate(Where("o_custkey", Compare.NOT_IN))
    groups = s.GroupCount("o_custkey")
    by_price = s.KeysetPage("o_totalprice", "o_orderkey")
    by_price_back = s.KeysetPage("o_totalprice", "o_orderkey", descending=True)
    erase_where = s.DeleteWhere(Where("o_totalprice", Compare.LESS), hard=True)
    erase_listed = s.DeleteWhere(Where("o_custkey", Compare.IN), hard=True)
    erase_unlisted = s.DeleteWhere(Where("o_custkey", Compare.NOT_IN), hard=True)


class SoftOrders(s.Store, entity=SoftOrder):
    all = s.SelectAll()
    with_deleted = s.SelectAll(include_deleted=True)
    with_closed = s.SelectAll(ignore_filters=("open",))
    names = s.SelectAll(projection=SoftOrderName)
    n = s.Count()
    groups = s.GroupCount("o_orderpriority", include_deleted=True)
    flat_or = s.SelectByPredicate(Where("o_totalprice", Compare.LESS), Where("o_custkey", Compare.LESS, or_=True))
    add = s.Insert()
    add_returning = s.Insert(returning=True)
    add_all = s.InsertAll()
    change = s.Update()
    change_returning = s.Update(returning=True)
    set_priority = s.UpdateWhere(("o_orderpriority",), Where("o_totalprice", Compare.LESS))
    set_listed = s.UpdateWhere(("o_orderpriority",), Where("o_custkey", Compare.IN))
    drop = s.Delete()
    erase = s.Delete(hard=True)
    erase_returning = s.Delete(hard=True, returning=True)
    erase_all = s.DeleteAll(hard=True)
    drop_where = s.DeleteWhere(Where("o_totalprice", Compare.LESS))
    restore = s.Restore()
    run_delete = s.Execute("o_orderpriority = :priority AND o_version = :version")
    run_update = s.Execute("o_totalprice BETWEEN :low AND :high", o_totalprice="round(o_totalprice * 2, 2)", o_orderpriority="concat(o_orderpriority, :mark)")


class Tenants(s.Store, entity=TenantCustomer):
    all = s.SelectAll()
    bulk = s.BulkInsert()
    erase_poor = s.DeleteWhere(Where("c_acctbal", Compare.LESS), hard=True)


class Customers(s.Store, entity=Customer):
    put = s.Upsert()
    change_all = s.UpdateAll()


class Events(s.Store, entity=Event):
    by_json = s.SelectByPredicate(Where("props", json_path="$.k"), Where("event_type", Compare.NOT_EQUAL))


class Documents(s.Store, entity=Document):
    search = s.FullTextSearch("source", "text")


class Lines(s.Store, entity=Line):
    returned = s.SelectAllByField("l_returnflag", "l_linestatus")
    flagship = s.SelectByPredicate(Where("l_quantity", Compare.LESS), Where("l_discount", Compare.GREATER), Where("l_returnflag", or_=True), Where("l_tax", Compare.LESS))


class Turns(s.Store, entity=Turn):
    one = s.SelectOneByKey()
    pages = s.KeysetPage("conv_id", "turn")


class Regions(s.Store, entity=Region):
    eager = s.SelectAllEager("nations")
    one = s.SelectOneEager("nations")


class Nations(s.Store, entity=Nation):
    eager = s.SelectAllEager("region", "customers", fields={"customers": ("c_custkey",)})


class OrdersWithParts(s.Store, entity=OrderParts):
    eager = s.SelectAllEager("parts", fields={"parts": ("p_partkey",)})
    parts_of = s.SelectRelated("parts")


class Parts(s.Store, entity=LabelledPart):
    all = s.SelectAll()
    of_brand = s.SelectAllByField("p_brand")


class StatusTotal(AdHoc, fields=("status", "n", "total")):
    pass


def _soft(spark: SparkSession, d: str) -> FrameTables:
    o = ParquetTables(spark, d).frame(Order)
    made = o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("o_deleted"), (F.col("o_orderpriority") != "1-URGENT").alias("o_open"), (F.col("o_custkey") % 5).cast("int").alias("o_version"))
    return FrameTables(spark, {"soft_orders": made})


def _nulls(spark: SparkSession, d: str) -> FrameTables:
    o = ParquetTables(spark, d).frame(Order)
    made = o.select("o_orderkey", F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_custkey")).alias("o_custkey"), F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("o_totalprice"))
    return FrameTables(spark, {"nullable_orders": made})


def _changed(store: type[s.Store], source, change: Callable[[s.Store], object]) -> DataFrame:
    """The table's rows after ``change`` of a store over ``source``."""
    made = store(StateTables(source.spark, source))
    change(made)
    return made.rows()


def _kept(spark: SparkSession, source=None) -> StateTables:
    """Tables whose states are written in the shared folder."""
    return StateTables(spark, source, f"{shared_dir(spark)}/quern/states-{uuid.uuid4().hex}")


def _version(store: s.Store, key: int) -> int:
    """The token that a client would have read with the row."""
    row = store.rows().where(F.col("o_orderkey") == key).first()
    return row.o_version if row else 0


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = " ".join(sql.split())
        return f

    return keep


O_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
L_COLS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
S_COLS = "o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_deleted, o_open, o_version"


def _orders(spark, d):
    return Orders(ParquetTables(spark, d))


# reads

query("flagship_predicate", f"SELECT {L_COLS} FROM lineitem WHERE l_quantity < 5 AND l_discount > 0.05 OR l_returnflag = 'R' AND l_tax < 0.02")(lambda sp, d: Lines(ParquetTables(sp, d)).flagship(5, 0.05, "R", 0.02))
query("q01_select_all", f"SELECT {O_COLS} FROM orders")(lambda sp, d: _orders(sp, d).all())
query("q01_select_active", f"SELECT {S_COLS} FROM ({SOFT}) WHERE NOT o_deleted AND o_open")(lambda sp, d: SoftOrders(_soft(sp, d)).all())
query("q02_include_deleted", f"SELECT {S_COLS} FROM ({SOFT}) WHERE o_open")(lambda sp, d: SoftOrders(_soft(sp, d)).with_deleted())
query("q03_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(lambda sp, d: _orders(sp, d).statuses())
query("q04_order_by", f"SELECT {O_COLS} FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 0")(lambda sp, d: _orders(sp, d).latest(0, 40))
query("q05_one_by_key", f"SELECT {O_COLS} FROM orders WHERE o_orderkey = 77 LIMIT 1")(lambda sp, d: _orders(sp, d).one(77))
query("q05_one_by_composite_key", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1 LIMIT 1")(lambda sp, d: Turns(ParquetTables(sp, d)).one(3, 1))
query("q06_by_fields", f"SELECT {O_COLS} FROM orders WHERE o_custkey = 22 AND o_orderstatus = 'O'")(lambda sp, d: _orders(sp, d).of_customer(22, "O"))
query("q07_derived_name", f"SELECT {O_COLS} FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")(lambda sp, d: _orders(sp, d).find_by_o_orderstatus_and_o_orderpriority("P", "5-LOW"))
query("q08_projection", "SELECT o_orderkey, o_totalprice FROM orders")(lambda sp, d: _orders(sp, d).summaries())
query("q08_projection_behind_filter", f"SELECT o_orderkey, o_orderpriority FROM ({SOFT}) WHERE NOT o_deleted AND o_open")(lambda sp, d: SoftOrders(_soft(sp, d)).names())
query("q09_distinct_ordered_page", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderstatus, o_orderpriority DESC LIMIT 7 OFFSET 3")(lambda sp, d: _orders(sp, d).ordered_statuses(3, 7))
query("q10_view_by_field", f"SELECT {L_COLS} FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")(lambda sp, d: Lines(ParquetTables(sp, d)).returned("A", "F"))
query("q11_top_by_order", "SELECT max(o_totalprice) AS o_totalprice FROM orders")(lambda sp, d: _orders(sp, d).dearest().select("o_totalprice"))
query("q12_offset_page", f"SELECT {O_COLS} FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")(lambda sp, d: _orders(sp, d).latest(50, 25))
query("q14_keyset_first", f"SELECT {O_COLS} FROM orders ORDER BY o_orderkey LIMIT 20")(lambda sp, d: _orders(sp, d).frame("by_key", None, 20))
query("q15_keyset_seek", f"SELECT {O_COLS} FROM orders WHERE o_orderkey > 400 ORDER BY o_orderkey LIMIT 20")(lambda sp, d: _orders(sp, d).frame("by_key", (400,), 20))
query("q16_keyset_composite", f"SELECT {O_COLS} FROM orders WHERE o_totalprice > 250000.0 OR o_totalprice = 250000.0 AND o_orderkey > 9 ORDER BY o_totalprice, o_orderkey LIMIT 30")(lambda sp, d: _orders(sp, d).frame("by_price", (250000.0, 9), 30))
query("q16_keyset_composite_key", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id > 5 OR conv_id = 5 AND turn > 1 ORDER BY conv_id, turn LIMIT 15")(lambda sp, d: Turns(ParquetTables(sp, d)).frame("pages", (5, 1), 15))
query("q17_keyset_backward", f"SELECT {O_COLS} FROM orders WHERE o_totalprice < 250000.0 OR o_totalprice = 250000.0 AND o_orderkey < 9 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 30")(lambda sp, d: _orders(sp, d).frame("by_price_back", (250000.0, 9), 30))


@query("q13_paged_result", "SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10 OFFSET 20")
def paged_result(spark, d):
    """The page and its total as a frame again."""
    page = _orders(spark, d).paged("F", 20, 10)
    return spark.createDataFrame([(r.o_orderkey, r.o_orderstatus, page.total) for r in page.items], "o_orderkey long, o_orderstatus string, total long")


query("q16_keyset_after_null", f"SELECT * FROM ({NULLS}) WHERE o_totalprice IS NULL AND o_orderkey > 50 OR o_totalprice IS NOT NULL ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 30000")(lambda sp, d: NullableOrders(_nulls(sp, d)).frame("by_price", (None, 50), 30000))
query("q17_keyset_backward_nulls", f"SELECT * FROM ({NULLS}) WHERE o_totalprice < 60000.0 OR o_totalprice IS NULL OR o_totalprice = 60000.0 AND o_orderkey < 9 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 30000")(lambda sp, d: NullableOrders(_nulls(sp, d)).frame("by_price_back", (60000.0, 9), 30000))


@query("stream_rows", "SELECT n_nationkey, n_name FROM nation")
def streamed(spark, d):
    """Rows of a read that came one after another, as a frame again."""
    rows = stream_rows(ParquetTables(spark, d).frame(Nation).select("n_nationkey", "n_name"))
    return spark.createDataFrame([tuple(r) for r in rows], "n_nationkey int, n_name string")


# predicates

query("q20_equal_not_equal", f"SELECT {O_COLS} FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")(lambda sp, d: _orders(sp, d).equal("F", "5-LOW"))
query("q21_ranges", f"SELECT {O_COLS} FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 300000 AND o_orderkey > 10 AND o_orderkey <= 900")(lambda sp, d: _orders(sp, d).prices(100000, 300000, 10, 900))
query("q22_between", f"SELECT * FROM ({NULLS}) WHERE o_totalprice BETWEEN 50000 AND 90000")(lambda sp, d: NullableOrders(_nulls(sp, d)).between(50000, 90000))
query("q23_not_between", f"SELECT * FROM ({NULLS}) WHERE o_totalprice NOT BETWEEN 50000 AND 90000")(lambda sp, d: NullableOrders(_nulls(sp, d)).outside(50000, 90000))
query("q24_null_tests", f"SELECT * FROM ({NULLS}) WHERE o_custkey IS NULL AND o_totalprice IS NOT NULL")(lambda sp, d: NullableOrders(_nulls(sp, d)).null())
query("q25_like", f"SELECT {O_COLS} FROM orders WHERE o_orderpriority LIKE '%LO_'")(lambda sp, d: _orders(sp, d).like("%LO_"))
query("q26_not_like", f"SELECT {O_COLS} FROM orders WHERE NOT (o_orderpriority LIKE '1%')")(lambda sp, d: _orders(sp, d).not_like("1%"))
query("q27_in", f"SELECT * FROM ({NULLS}) WHERE o_custkey IN (1, 5, 9, 9, 40)")(lambda sp, d: NullableOrders(_nulls(sp, d)).listed([1, 5, 9, 9, 40]))
query("q27_in_empty", f"SELECT * FROM ({NULLS}) WHERE false")(lambda sp, d: NullableOrders(_nulls(sp, d)).listed([]))
query("q27_in_long", f"SELECT * FROM ({NULLS}) WHERE o_custkey % 3 = 0 AND o_custkey < 6000")(lambda sp, d: NullableOrders(_nulls(sp, d)).listed(list(range(0, 6000, 3))))
query("q28_not_in", f"SELECT * FROM ({NULLS}) WHERE o_custkey NOT IN (1, 5, 9)")(lambda sp, d: NullableOrders(_nulls(sp, d)).unlisted([1, 5, 9]))
query("q28_not_in_empty", f"SELECT * FROM ({NULLS})")(lambda sp, d: NullableOrders(_nulls(sp, d)).unlisted(None))
query("q28_not_in_null", f"SELECT * FROM ({NULLS}) WHERE o_custkey NOT IN (1, NULL)")(lambda sp, d: NullableOrders(_nulls(sp, d)).unlisted([1, None]))
query("q28_not_in_long", f"SELECT * FROM ({NULLS}) WHERE o_custkey IS NOT NULL AND NOT (o_custkey % 3 = 0 AND o_custkey < 6000)")(lambda sp, d: NullableOrders(_nulls(sp, d)).unlisted(list(range(0, 6000, 3))))
query("q29_or_of_ands", f"SELECT {O_COLS} FROM orders WHERE o_totalprice < 60000 AND o_orderstatus = 'O' OR o_orderpriority = '2-HIGH' AND o_custkey < 100")(lambda sp, d: _orders(sp, d).flat_or(60000, "O", "2-HIGH", 100))
query("q29_or_within_filters", f"SELECT {S_COLS} FROM ({SOFT}) WHERE (o_totalprice < 60000 OR o_custkey < 100) AND NOT o_deleted AND o_open")(lambda sp, d: SoftOrders(_soft(sp, d)).flat_or(60000, 100))
query("q30_json_path", "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE json_extract_string(props, '$.k') = '42' AND event_type <> 'error'")(lambda sp, d: Events(ParquetTables(sp, d)).by_json("42", "error"))

# filters

query("filter_named_bypass", f"SELECT {S_COLS} FROM ({SOFT}) WHERE NOT o_deleted")(lambda sp, d: SoftOrders(_soft(sp, d)).with_closed())


@query("filter_tenant_scope", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey = 7")
def tenant_scope(spark, d):
    with filter_scope(nation=7):
        return Tenants(ParquetTables(spark, d)).all()


# aggregates

query("q40_count", "SELECT count(*) AS count FROM orders")(lambda sp, d: _orders(sp, d).n())
query("q40_count_active", f"SELECT count(*) AS count FROM ({SOFT}) WHERE NOT o_deleted AND o_open")(lambda sp, d: SoftOrders(_soft(sp, d)).n())
query("q41_count_by_field", "SELECT count(*) AS count FROM orders WHERE o_custkey = 22 AND o_orderstatus = 'O'")(lambda sp, d: _orders(sp, d).of_customer(22, "O").agg(F.count(F.lit(1)).alias("count")))
query("q42_exists", 'SELECT count(*) > 0 AS "exists" FROM orders WHERE o_totalprice > 400000')(lambda sp, d: _orders(sp, d).any_dear(400000))
query("q42_exists_not", 'SELECT count(*) > 0 AS "exists" FROM orders WHERE o_totalprice > 1e12')(lambda sp, d: _orders(sp, d).any_dear(1e12))
query("q43_sum", "SELECT CAST(sum(o_custkey) AS BIGINT) AS value FROM orders")(lambda sp, d: _orders(sp, d).total())
query("q44_avg", "SELECT round(avg(o_totalprice), 4) AS value FROM orders")(lambda sp, d: _orders(sp, d).mean().select(F.round("value", 4).alias("value")))
query("q45_min", "SELECT min(o_totalprice) AS value FROM orders")(lambda sp, d: _orders(sp, d).least())
query("q46_max", "SELECT max(o_orderdate) AS value FROM orders")(lambda sp, d: _orders(sp, d).most())
query("q47_group_count", "SELECT o_orderpriority AS key, count(*) AS count FROM orders GROUP BY 1")(lambda sp, d: _orders(sp, d).groups())
query("q47_group_count_null_key", f"SELECT o_custkey AS key, count(*) AS count FROM ({NULLS}) GROUP BY 1")(lambda sp, d: NullableOrders(_nulls(sp, d)).groups())
query("q47_group_count_deleted_too", f"SELECT o_orderpriority AS key, count(*) AS count FROM ({SOFT}) WHERE o_open GROUP BY 1")(lambda sp, d: SoftOrders(_soft(sp, d)).groups())
query("q50_full_text", "SELECT doc_id, text, lang, source FROM documents WHERE list_contains(regexp_split_to_array(lower(source || ' ' || text), '[^a-z0-9]+'), 'the') AND list_contains(regexp_split_to_array(lower(source || ' ' || text), '[^a-z0-9]+'), 'src3')")(lambda sp, d: Documents(ParquetTables(sp, d)).search("The SRC3"))

# relations

PARENTS = "SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'"


def _a_regions(sp, d):
    return ParquetTables(sp, d).frame(Region).where("r_name like 'A%'")


query("q60_children_of", f"SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN ({PARENTS})")(lambda sp, d: relations.children_of(ParquetTables(sp, d).frame, _a_regions(sp, d), Region, Region.relations["nations"]))
query("q61_parent_of", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 77)")(lambda sp, d: relations.parent_of(ParquetTables(sp, d).frame, _orders(sp, d).one(77), Order.relations["customer"]))
query("q62_linked_of_one", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_orderkey = 77")(lambda sp, d: OrdersWithParts(ParquetTables(sp, d)).parts_of(77))
query("q63_linked_of_many", "SELECT l_orderkey AS parent, p_partkey, p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')")(lambda sp, d: relations.linked_rows(ParquetTables(sp, d).frame, ParquetTables(sp, d).frame(OrderParts).where("o_orderpriority = '2-HIGH'"), OrderParts, OrderParts.relations["parts"]).select(F.col("__parent").alias("parent"), "p_partkey", "p_name"))


class Said(Entity, table="said", view=True):
    s_role = Column("string")
    s_conv = Column("long")
    s_turn = Column("long")


class Role(Entity, table="roles"):
    role = Column("string", key=True)
    turns = ManyToMany(Turn, junction=Said, parent_key="s_role", child_keys=("s_conv", "s_turn"))


@query("q64_composite_child_key", "SELECT role AS parent, conv_id, turn, length(text) AS n_chars FROM conversations")
def composite_child(spark, d):
    """A junction made from the conversations, from who speaks to children with a key of two columns."""
    turns = ParquetTables(spark, d).frame(Turn)
    frames = {"conversations": turns, "said": turns.select("role", "conv_id", "turn").toDF("s_role", "s_conv", "s_turn"), "roles": turns.select("role").distinct()}
    tables = FrameTables(spark, frames)
    rows = relations.linked_rows(tables.frame, tables.frame(Role), Role, Role.relations["turns"])
    return rows.select(F.col("__parent").alias("parent"), "conv_id", "turn", F.length("text").cast("long").alias("n_chars"))


query("q65_junction_rows", "SELECT l_orderkey AS parent, l_partkey AS child FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH') AND l_partkey IN (SELECT p_partkey FROM part)")(lambda sp, d: relations.junction_rows(ParquetTables(sp, d).frame, ParquetTables(sp, d).frame(OrderParts).where("o_orderpriority = '2-HIGH'"), OrderParts, OrderParts.relations["parts"]).select(F.col("__parent").alias("parent"), F.col("__child_0").alias("child")))
query("q70_eager_collection", "SELECT r_regionkey, r_name, n_nationkey AS nations_n_nationkey, n_name AS nations_n_name, n_regionkey AS nations_n_regionkey FROM region LEFT JOIN nation ON n_regionkey = r_regionkey")(lambda sp, d: Regions.eager.flat(Regions(ParquetTables(sp, d)), "nations"))
query("q70_eager_lists", "SELECT r_regionkey, count(n_nationkey) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")(lambda sp, d: Regions(ParquetTables(sp, d)).eager().select("r_regionkey", F.size("nations").cast("long").alias("n"), F.array_join("nations.n_name", ",").alias("names")))
query("q71_eager_reference", "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2")(lambda sp, d: _nations_without(sp, d, 2))
query("q72_one_eager", "SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 3 GROUP BY 1")(lambda sp, d: Regions(ParquetTables(sp, d)).one(3).select("r_regionkey", F.size("nations").cast("long").alias("n")))
query("q73_eager_many_to_many", "SELECT o_orderkey, count(l_partkey) AS n, CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(lambda sp, d: OrdersWithParts(ParquetTables(sp, d)).eager().select("o_orderkey", F.size("parts").cast("long").alias("n"), F.expr("aggregate(parts.p_partkey, 0L, (a, x) -> a + x)").alias("total")))
query("q74_eager_mixed", "SELECT n_nationkey, r_name, count(c_custkey) AS customers FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")(lambda sp, d: Nations(ParquetTables(sp, d)).eager().select("n_nationkey", F.col("region.r_name").alias("r_name"), F.size("customers").cast("long").alias("customers")))


def _nations_without(spark, d, region):
    t = ParquetTables(spark, d)
    tables = FrameTables(spark, {"nation": t.frame(Nation), "region": t.frame(Region).where(F.col("r_regionkey") != region)})
    return relations.eager(tables.frame, tables.frame(Nation), Nation, ("region",)).select("n_nationkey", "n_name", F.col("region.r_regionkey").alias("r_regionkey"), F.col("region.r_name").alias("r_name"))


class Author(Entity, table="soft_customers"):
    c_custkey = Column("long", key=True)
    c_deleted = Column("bool", nullable=False, soft_delete=True)
    orders = HasMany(SoftOrder, "o_custkey")


class Authors(s.Store, entity=Author):
    eager = s.SelectAllEager("orders", fields={"orders": ("o_orderkey",)}, include_deleted=True)


@query("q75_eager_deleted_parents", f"SELECT c_custkey, c_mktsegment = 'FURNITURE' AS c_deleted, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM ({SOFT}) WHERE NOT o_deleted AND o_open) ON o_custkey = c_custkey GROUP BY 1, 2")
def eager_deleted_parents(spark, d):
    """Deleted parents are shown, their children keep their own filters."""
    frames = _soft(spark, d).frames | {"soft_customers": ParquetTables(spark, d).frame(Customer).select("c_custkey", (F.col("c_mktsegment") == "FURNITURE").alias("c_deleted"))}
    return Authors(FrameTables(spark, frames)).eager().select("c_custkey", "c_deleted", F.size("orders").cast("long").alias("n"))


# writes: the table's state afterwards

NEW = "(SELECT o_orderkey + 1000000000 AS o_orderkey, o_custkey, o_totalprice, o_orderpriority, false AS o_deleted, true AS o_open, 0 AS o_version FROM orders WHERE o_orderstatus = 'P')"


def _new(spark, d):
    rows = ParquetTables(spark, d).frame(Order).where("o_orderstatus = 'P'")
    return rows.select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), "o_custkey", "o_totalprice", "o_orderpriority", F.lit(True).alias("o_open"))


def _more(spark, d):
    return ParquetTables(spark, d).frame(Order).select((F.col("o_orderkey") + 2000000000).alias("o_orderkey"), "o_custkey", "o_totalprice", "o_orderpriority")


def _suppliers(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 5000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))


ONE = "SELECT CAST(5000000001 AS BIGINT) AS o_orderkey, CAST(3 AS BIGINT) AS o_custkey, CAST(12.5 AS DOUBLE) AS o_totalprice, '1-URGENT' AS o_orderpriority, false AS o_deleted, true AS o_open, 0 AS o_version"
ROW = {"o_orderkey": 5000000001, "o_custkey": 3, "o_totalprice": 12.5, "o_orderpriority": "1-URGENT", "o_open": True}

query("q80_insert", f"SELECT {S_COLS} FROM ({SOFT}) UNION ALL SELECT {S_COLS} FROM {NEW}")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.add_all(_new(sp, d))))
query("q80_insert_one", f"SELECT {S_COLS} FROM ({SOFT}) UNION ALL {ONE}")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.add(**ROW)))


@query("q81_inserted_rows", f"SELECT {S_COLS} FROM {NEW}")
def inserted_rows(spark, d):
    """The batch as the table holds it afterwards, found by its own keys; their bounds only spare the join rows that cannot match."""
    given = _new(spark, d)
    rows = _changed(SoftOrders, _soft(spark, d), lambda t: t.add_all(given))
    bounds = given.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return rows.where(F.col("o_orderkey").between(*bounds)).join(given.select("o_orderkey"), "o_orderkey", "left_semi")


query("q81_insert_returning", ONE)(lambda sp, d: _as_frame(SoftOrders(StateTables(sp, _soft(sp, d))), lambda t: t.add_returning(**ROW)))
query("q82_insert_all", f"SELECT {S_COLS} FROM ({SOFT}) UNION ALL SELECT o_orderkey + 2000000000, o_custkey, o_totalprice, o_orderpriority, false, NULL, 0 FROM orders")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.add_all(_more(sp, d))))
query("q83_bulk_insert", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey + 5000000, s_name, s_nationkey, s_acctbal FROM supplier")(lambda sp, d: _changed(Tenants, ParquetTables(sp, d), lambda t: t.bulk(_suppliers(sp, d))))


def _as_frame(store, operation):
    """The one row that an operation returns, as a frame."""
    row = operation(store)
    return store.spark.createDataFrame([] if row is None else [row], store.rows().schema)


@query("q84_upsert", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new ' || c_custkey ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT s_suppkey + 9000000000, 'new ' || (s_suppkey + 9000000000), s_nationkey, 1.5, 'SUPPLIER' FROM supplier")
def upsert(spark, d):
    state = ParquetTables(spark, d).frame(Customer)
    fresh = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 9000000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("SUPPLIER").alias("c_mktsegment"))
    given = state.where("c_mktsegment = 'BUILDING'").unionByName(fresh).withColumn("c_name", F.concat(F.lit("new "), F.col("c_custkey").cast("string"))).withColumn("c_acctbal", F.lit(1.5))
    return _changed(Customers, ParquetTables(spark, d), lambda t: t.put(given))


class Note(Entity, table="notes"):
    note_id = Column("long", key=True, generated=True)
    title = Column("string")


class Notes(s.Store, entity=Note):
    add_all = s.InsertAll()
    put = s.Upsert()


@query("q85_upsert_generated_key", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS note_id, CASE WHEN n_nationkey = 4 THEN 'changed' ELSE n_name END AS title FROM nation UNION ALL SELECT 26, 'added'")
def upsert_generated(spark, d):
    """Keys are made for rows without one, in order where the batch is one file; rows with one replace theirs."""
    notes = Notes(_kept(spark))
    notes.tables.create(Note, spark.createDataFrame([], "note_id long, title string"))
    notes.add_all(ParquetTables(spark, d).frame(Nation).repartition(1).sortWithinPartitions("n_nationkey").select(F.col("n_name").alias("title")))
    notes.put([{"note_id": 5, "title": "changed"}, {"title": "added"}])
    return notes.rows()


class Labelled(Entity, table="labelled"):
    id = Column("guid", key=True, sequential_guid=True)
    name = Column("string")


class Labels(s.Store, entity=Labelled):
    add_all = s.InsertAll()


@query("q112_sequential_guid", "SELECT n_name AS name, 36 AS n_chars, '7' AS version, CAST(25 AS BIGINT) AS different FROM nation")
def sequential_guids(spark, d):
    labels = Labels(_kept(spark))
    labels.tables.create(Labelled, spark.createDataFrame([], "id string, name string"))
    labels.add_all(ParquetTables(spark, d).frame(Nation).select(F.col("n_name").alias("name")))
    rows = labels.rows()
    different = adhoc.scalar(rows.agg(F.countDistinct("id")), 0)
    return rows.select("name", F.length("id").alias("n_chars"), F.substring("id", 15, 1).alias("version"), F.lit(different).cast("long").alias("different"))


query("q90_update_by_key", f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 77 AND o_version = o_custkey % 5 THEN 1.0 ELSE o_totalprice END AS o_totalprice, o_orderpriority, o_deleted, o_open, CASE WHEN o_orderkey = 77 THEN o_version + 1 ELSE o_version END AS o_version FROM ({SOFT})")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.change(o_orderkey=77, o_totalprice=1, o_version=_version(t, 77))))
query("q90_update_returning", f"SELECT o_orderkey, o_custkey, CAST(1 AS DOUBLE) AS o_totalprice, o_orderpriority, o_deleted, o_open, o_version + 1 AS o_version FROM ({SOFT}) WHERE o_orderkey = 77")(lambda sp, d: _as_frame(SoftOrders(StateTables(sp, _soft(sp, d))), lambda t: t.change_returning(o_orderkey=77, o_totalprice=1, o_version=_version(t, 77))))


@query("q91_update_all", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN upper(c_mktsegment) || c_custkey ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def update_all(spark, d):
    given = ParquetTables(spark, d).frame(Customer).where("c_acctbal > 0").select("c_custkey", F.concat(F.upper("c_mktsegment"), F.col("c_custkey").cast("string")).alias("c_name"))
    return _changed(Customers, ParquetTables(spark, d), lambda t: t.change_all(given))


@query("q66_update_join", "SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(paid, o_totalprice) AS o_totalprice, o_orderdate, o_orderpriority FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS paid FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def update_join(spark, d):
    """Orders updated in one join from values computed over their lines."""
    tables = ParquetTables(spark, d)
    values = tables.frame(Line).where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return _changed(Orders, tables, lambda t: t.change_all(values))


SET_X = "SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN {0} AND NOT o_deleted AND o_open THEN 'X' ELSE o_orderpriority END AS o_orderpriority, o_deleted, o_open, CASE WHEN {0} AND NOT o_deleted AND o_open THEN o_version + 1 ELSE o_version END AS o_version FROM (" + SOFT + ")"

query("q92_update_where", SET_X.format("o_totalprice < 90000"))(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.set_priority("X", 90000)))
query("q92_update_where_listed", SET_X.format("o_custkey % 2 = 0 AND o_custkey < 4000"))(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.set_listed("X", list(range(0, 4000, 2)))))
query("q93_soft_delete_by_key", f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_deleted OR o_orderkey = 77 AS o_deleted, o_open, CASE WHEN o_orderkey = 77 THEN o_version + 1 ELSE o_version END AS o_version FROM ({SOFT})")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.drop(77, o_version=_version(t, 77))))
query("q94_hard_delete_by_key", f"SELECT {S_COLS} FROM ({SOFT}) WHERE NOT o_orderkey = 77")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.erase(77, o_version=_version(t, 77))))
query("q94_delete_returning", f"SELECT {S_COLS} FROM ({SOFT}) WHERE o_orderkey = 77")(lambda sp, d: _as_frame(SoftOrders(StateTables(sp, _soft(sp, d))), lambda t: t.erase_returning(77, o_version=_version(t, 77))))
query("q95_delete_all", f"SELECT {S_COLS} FROM ({SOFT}) WHERE o_orderkey NOT IN (1, 2, 3, 500)")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.erase_all([1, 2, 3, 500])))
query("q96_soft_delete_where", f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_deleted OR (o_totalprice < 90000 AND o_open) AS o_deleted, o_open, CASE WHEN o_totalprice < 90000 AND NOT o_deleted AND o_open THEN o_version + 1 ELSE o_version END AS o_version FROM ({SOFT})")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.drop_where(90000)))
query("q96_hard_delete_where_unknown_stays", f"SELECT * FROM ({NULLS}) WHERE NOT coalesce(o_totalprice < 200000, false)")(lambda sp, d: _changed(NullableOrders, _nulls(sp, d), lambda t: t.erase_where(200000)))
query("q96_delete_where_long_list", f"SELECT * FROM ({NULLS}) WHERE NOT coalesce(o_custkey % 3 = 0 AND o_custkey < 6000, false)")(lambda sp, d: _changed(NullableOrders, _nulls(sp, d), lambda t: t.erase_listed(list(range(0, 6000, 3)))))
query("q96_delete_where_list_with_null", f"SELECT * FROM ({NULLS})")(lambda sp, d: _changed(NullableOrders, _nulls(sp, d), lambda t: t.erase_unlisted([None, *range(0, 6000, 3)])))


@query("q96_delete_where_enforced", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE NOT (c_acctbal < 0 AND c_nationkey = 7)")
def delete_enforced(spark, d):
    with filter_scope(nation=7):
        return _changed(Tenants, ParquetTables(spark, d), lambda t: t.erase_poor(0))


def _stale(spark, d):
    """A change with a token that is not the row's touches nothing; with the right one the row goes."""

    def change(store):
        version = _version(store, 77)
        store.erase(77, o_version=version + 1)
        store.change(o_orderkey=1, o_orderpriority="lost", o_version=_version(store, 1) + 1)
        store.erase(77, o_version=version)

    return _changed(SoftOrders, _soft(spark, d), change)


query("q97_restore_by_key", f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_deleted AND o_orderkey <> 1 AS o_deleted, o_open, o_version FROM ({SOFT})")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.restore(1)))
query("q98_optimistic_token", f"SELECT {S_COLS} FROM ({SOFT}) WHERE NOT (o_orderpriority = '4-NOT SPECIFIED' AND o_version = 3)")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.run_delete(priority="4-NOT SPECIFIED", version=3)))
query("q98_stale_token", f"SELECT {S_COLS} FROM ({SOFT}) WHERE o_orderkey <> 77")(_stale)
query("q104_execute", f"SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice BETWEEN 1000 AND 90000 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, CASE WHEN o_totalprice BETWEEN 1000 AND 90000 THEN o_orderpriority || '!' ELSE o_orderpriority END AS o_orderpriority, o_deleted, o_open, o_version FROM ({SOFT})")(lambda sp, d: _changed(SoftOrders, _soft(sp, d), lambda t: t.run_update(low=1000, high=90000, mark="!")))

# hand-written SQL, computed columns, converters


def _views(spark, d, *names):
    for n in names:
        spark.read.parquet(f"{d}/{n}.parquet").createOrReplaceTempView(n)


@query("q100_ad_hoc", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 50000 GROUP BY 1")
def ad_hoc(spark, d):
    _views(spark, d, "orders")
    return adhoc.query(spark, "SELECT o_orderstatus, count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_totalprice > :least GROUP BY 1", StatusTotal, least=50000)


@query("q103_several", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'parts', count(*) FROM part WHERE p_size > 10")
def several(spark, d):
    _views(spark, d, "orders", "part")
    a, b = adhoc.several(spark, "SELECT 'orders' AS name, count(*) AS n FROM orders", "SELECT 'parts' AS name, count(*) AS n FROM part WHERE p_size > :size", size=10)
    return a.unionByName(b)


@query("q101_single_row", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def single_row(spark, d):
    """The only row of a result, as a frame again."""
    _views(spark, d, "orders")
    df = adhoc.query(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = :key", key=77)
    row = adhoc.single_or_none(df)
    return spark.createDataFrame([] if row is None else [row], df.schema)


@query("q102_scalar", "SELECT CAST(count(*) AS BIGINT) AS value FROM orders WHERE o_orderstatus = 'P'")
def scalar(spark, d):
    _views(spark, d, "orders")
    found = adhoc.scalar(adhoc.query(spark, "SELECT count(*) FROM orders WHERE o_orderstatus = :status", status="P"), 0)
    return spark.createDataFrame([(found,)], "value long")


@query("ad_hoc_window", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders QUALIFY nth <= 3")
def ad_hoc_window(spark, d):
    """SQL beyond the declared operations stays reachable."""
    _views(spark, d, "orders")
    return adhoc.query(spark, "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS nth FROM orders) WHERE nth <= :k", k=3)


query("q110_computed_column", "SELECT p_partkey, replace(p_brand, 'Brand#', '') AS p_brand, p_name || ' / ' || p_type AS p_label, p_name, p_type FROM part")(lambda sp, d: Parts(ParquetTables(sp, d)).all())
query("q111_converter", "SELECT p_partkey, replace(p_brand, 'Brand#', '') AS p_brand, p_name || ' / ' || p_type AS p_label, p_name, p_type FROM part WHERE p_brand = 'Brand#4'")(lambda sp, d: Parts(ParquetTables(sp, d)).of_brand("4"))


class Priority(Enum):
    URGENT = "1-URGENT"
    HIGH = "2-HIGH"


class PriorityOrder(Entity, table="named_orders"):
    o_orderkey = Column("long", key=True)
    priority = Column("string", converter=as_name(Priority))
    detail = Column("string", converter=as_json("struct<status:string,customer:bigint>"))


class PriorityOrders(s.Store, entity=PriorityOrder):
    of = s.SelectAllByField("priority")
    with_detail = s.SelectAllByField("detail")


def _named(spark, d):
    o = ParquetTables(spark, d).frame(Order).where("o_orderpriority in ('1-URGENT', '2-HIGH')")
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "URGENT").otherwise("HIGH").alias("priority")
    return FrameTables(spark, {"named_orders": o.select("o_orderkey", name, F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))).alias("detail"))})


query("q111_enum_as_name", "SELECT o_orderkey, 'URGENT' AS priority, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT'")(lambda sp, d: PriorityOrders(_named(sp, d)).of(Priority.URGENT).select("o_orderkey", "priority", F.col("detail.status").alias("status")))
query("q111_json_value", "SELECT o_orderkey, o_custkey AS customer FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' AND o_custkey = 22")(lambda sp, d: PriorityOrders(_named(sp, d)).with_detail({"status": "O", "customer": 22}).select("o_orderkey", F.col("detail.customer").alias("customer")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
