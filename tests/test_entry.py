"""Driver contract: entry() runs, every query of the library has an oracle,
and every query equals its DuckDB oracle on sf0.001."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from shotgrid.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"video_source", "index", "time_start", "time_stop", "object_name"} <= set(df.columns)
    assert df.count() >= 0


def test_every_query_has_oracle():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, got) == canon(ocols, rel.fetchall())
    assert not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)
