"""Registered queries: names, columns, and SQL where it exists."""

import duckdb
import pytest

from thicket.llm.queries import ORACLE_SQL, QUERIES


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_each(spark, tables, tokenizers, name):
    table = "pages" if name.startswith("op9") else "documents"
    assert QUERIES[name](spark, tables).count() == spark.read.parquet(f"{tables}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, tables, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tables}/documents.parquet'")
    want = c.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, tables).select(*want.columns)
    assert {tuple(r) for r in df.collect()} == set(want.fetchall())
