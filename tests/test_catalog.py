"""Every catalogued query against its SQL in DuckDB."""

import math
from datetime import datetime

import duckdb
import pytest

from quern import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    return v.isoformat() if isinstance(v, datetime) else v


def test_catalogue_is_whole():
    assert set(catalog.oracle_sql()) == set(catalog.queries()) and len(catalog.queries()) > 70


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    theirs = sorted(repr([plain(v) for v in (r[names.index(c)] for c in order)]) for r in found.fetchall())
    assert mine == theirs


ODD_KEYS = "(0, 'P'), (-7, 'P'), (-2000000000, 'P'), (3, 'P'), (4000000000, 'P'), (4500000000, 'O'), (6000000000, 'F'), (1, 'F'), (2, NULL)"


@pytest.mark.parametrize("keys", [ODD_KEYS, "(0, 'O'), (4000000000, 'F')"], ids=["odd keys", "empty batch"])
def test_inserted_rows_of_any_key(spark, tmp_path, keys):
    """The batch comes back whole from keys at and below 0, and rows that the table had stay out however high their keys."""
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE orders AS SELECT k::BIGINT AS o_orderkey, 11::BIGINT AS o_custkey, s AS o_orderstatus, 2.5::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-02' AS o_orderdate, '2-HIGH' AS o_orderpriority FROM (VALUES {keys}) v(k, s)")
    duck.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    found = catalog.queries()["q81_inserted_rows"](spark, str(tmp_path))
    theirs = duck.execute(catalog.oracle_sql()["q81_inserted_rows"])
    assert found.columns == [c[0] for c in theirs.description]
    assert sorted(tuple(r) for r in found.collect()) == sorted(theirs.fetchall())
