"""The queries that SQL can express, against their SQL."""

import duckdb
import pytest


@pytest.mark.parametrize("name", ["op3_hamming_topk", "op9_jaccard_join"])
def test_same_rows(spark, sf, name):
    from loomgrid.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    theirs = con.sql(queries.oracle_sql()[name])
    ours = queries.queries()[name](spark, sf).select(*theirs.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())
