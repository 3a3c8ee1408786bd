"""The queries SQL can express equal their DuckDB answers on sf0.001."""

from __future__ import annotations

import duckdb
import pytest

from shotgrid.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    rel = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in rel.fetchall())
    assert sorted(map(tuple, df.collect())) == want


def test_registered_oracles_are_queries():
    assert set(oracle.oracle_sql()) <= set(queries.queries())
