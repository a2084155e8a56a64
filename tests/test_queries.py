"""Every registered panel query against its SQL twin on the smallest tables."""

import os

import pytest

from panelforge import catalog

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted((tuple(str(v) for v in r) for r in rows))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})")
    assert canonical(df.select(*columns).collect()) == canonical(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
