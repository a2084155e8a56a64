"""The registered queries and their SQL."""

import os

import pytest

from panelforge.llm import entries

SF = "/root/testdata/sf0.001"


def test_names():
    assert [int(n[2:].split("_")[0]) for n in entries.queries() if n != "pipeline"] == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_top_k_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = entries.queries()["op8_topk_search"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(entries.OP8_SQL).fetchall())
