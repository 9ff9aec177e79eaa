"""What SQL can express of the operators' results, against DuckDB over the same tables."""

import duckdb
import pytest

from quern.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = catalog.queries()[name](spark, SF)
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(found.fetchall())


def test_each_operator_has_one_query():
    assert sorted(n for n in catalog.queries() if n.startswith("op")) == sorted(f"op{k}_{n}" for k, n in enumerate("main_text interleaved_media benchmark_copies licences token_counts byte_bpe pii id_blocks quality near_duplicates".split(), 1))
