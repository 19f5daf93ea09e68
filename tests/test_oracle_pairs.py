"""Every registered query against its DuckDB oracle at sf0.001 (row count,
column names and an order-insensitive value hash, as the driver checks)."""

import duckdb
import pytest

import __spark_entry__ as E
from codelens.plans.queries import QUERIES
from tools.compare import TABLES, table_hash

SF = "/root/testdata/sf0.001"
SPARK_TO_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[key])
    ocols = rel.columns
    spark_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert table_hash(df.columns, srows) == table_hash(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "rank" in df.columns
