"""Videos in several parts: the same rows for any part size, without a row or a task that holds a whole video."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from conftest import seg
from pyspark.sql import functions as F

from shotgrid.operators import chunks, summaries
from shotgrid.plans import numbering, oracle, queries
from shotgrid.sources import fixtures as fx
from shotgrid.sources import parts as P

SF = "/root/testdata/sf0.001"
KEYS = {"chunks_min_duration": lambda c: c, "chunk_manifest": chunks.chunk_manifest,
        "chunk_manifest_file_numbering": lambda c: chunks.chunk_manifest(c, numbering="file")}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Events of which one user holds a third (of equal times, too)."""
    d = str(tmp_path_factory.mktemp("hot"))
    ev = spark.read.parquet(f"{SF}/events.parquet")
    hot = ev.where("event_id % 3 = 0").withColumn("user_id", F.lit(1).cast(ev.schema["user_id"].dataType))
    ev.where("event_id % 3 <> 0").union(hot).write.parquet(f"{d}/events.parquet")
    return d


def wanted(sf_dir, key):
    con = duckdb.connect()
    files = f"{sf_dir}/events.parquet" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/events.parquet") else "")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{files}')")
    rel = con.execute(oracle.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(r[i] for i in order) for r in rel.fetchall())


def rows(df):
    df = queries.widen(df)
    names = sorted(df.columns)
    return names, sorted(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("size", [10, 1_000, None])
def test_part_size_changes_no_row(spark, hot, size):
    for sf_dir in (SF, hot):
        parts = fx.event_shot_parts(spark, sf_dir, size)
        longest = parts.select(F.explode("annotation_results.shot_annotations").alias("s")).agg(F.max(F.size("s"))).first()[0]
        assert size is None or longest <= size
        made = chunks.min_duration_chunks_of_parts(parts, queries.CHUNK_MIN_SECONDS)
        for key, shape in KEYS.items():
            assert rows(shape(made)) == wanted(sf_dir, key), key
        assert rows(chunks.shots_of_parts(parts)) == wanted(sf_dir, "shots_enumerated")


@pytest.mark.parametrize("size", [1, 3, 100])
def test_parts_of_documents(spark, docs_from, size):
    rng = random.Random(size)

    def shots(n):
        cuts = sorted(rng.sample(range(200), n + 1))
        return [seg(a / 4, b / 4) for a, b in zip(cuts, cuts[1:])]

    docs = docs_from(*({"annotation_results": [{"input_uri": f"/b/{i}", "shot_annotations": shots(n)},
                                               {"input_uri": f"/b/{i}"}, {"input_uri": f"/c/{i}", "shot_annotations": shots(7)}]}
                       for i, n in enumerate((0, 1, 5, 40)))).good
    parts = P.shot_parts(docs, size)
    assert rows(chunks.min_duration_chunks_of_parts(parts, 3.0)) == rows(chunks.min_duration_chunks(docs, 3.0))
    assert rows(chunks.shots_of_parts(parts)) == rows(chunks.shots_enumerated(docs))


def test_part_maps_compose_to_the_sequential_rule():
    rng = random.Random(11)
    for _ in range(400):
        n, least = rng.randint(1, 40), rng.choice([0.0, 1.0, 4.0, 9.5])
        starts = sorted(rng.uniform(0, 60) for _ in range(n))
        ends = [s + rng.choice([0.0, 0.5, 3.0, 20.0]) * rng.random() for s in starts]
        want = list(chunks.merge_min_duration(starts, ends, least))
        cuts = sorted({0, n, *rng.choices(range(n + 1), k=rng.randint(0, 6))})
        opened, got, closed = None, [], 0
        for a, b in zip(cuts, cuts[1:]):
            mine = list(chunks.merge_min_duration(starts[a:b], ends[a:b], least, opened))
            opened, count = chunks.follow(chunks.part_map(starts[a:b], ends[a:b], least), opened, least)
            assert count == len(mine)
            got += mine
            closed += count
        assert got == want and closed == len(want)


def sequential_merge(intervals):
    out = []
    for a, b in sorted(intervals):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + 1)
        else:
            out.append((a, b, 1))
    return out


def test_one_hot_key_over_a_million_buckets(spark):
    rng = random.Random(5)
    hot = [(rng.uniform(-1e5, 1e6), rng.choice([0.1, 1.0, 2.5])) for _ in range(20_000)] + [(5_000.0, 40_000.0), (7_000.25, 1.0)]
    data = [("hot", a, a + n) for a, n in hot] + [(None, 1.0, 2.0), (None, 1.5, 9.0), ("x", 3.0, 3.0), ("x", 3.0, 3.0), ("y", None, 2.0)]
    df = spark.createDataFrame(data, "k string, start double, end double")
    got = summaries.merge_intervals(df, ["k"], width=1.0).collect()
    mine = sorted((r.seg_start, r.seg_end, r.n_merged) for r in got if r.k == "hot")
    assert mine == sequential_merge([(a, b) for k, a, b in data if k == "hot"])
    assert sorted((r.seg_start, r.seg_end, r.n_merged) for r in got if r.k is None) == [(1.0, 9.0, 2)]
    assert sorted((r.seg_start, r.seg_end, r.n_merged) for r in got if r.k == "x") == sequential_merge([(3.0, 3.0)] * 2)


def test_max_before_equals_a_running_maximum(spark):
    rng = random.Random(6)
    data = [(k, b, rng.choice([None, rng.uniform(0, 99)])) for k in ("a", "b", None) for b in rng.sample(range(-300, 300), 120)]
    df = spark.createDataFrame(data, "k string, b long, v double")
    got = {(r.k, r.b): r.m for r in numbering.max_before(df, ["k"], "b", "v", "m", fan=3, levels=3).collect()}
    for k, b, _ in data:
        earlier = [v for kk, bb, v in data if kk == k and bb < b and v is not None]
        assert got[k, b] == (max(earlier) if earlier else None)


def test_numbered_counts_inside_each_key(spark):
    data = [("hot", i % 50) for i in range(3000)] + [("b", 2), ("b", 1), (None, 7), (None, 7)]
    got = numbering.numbered(spark.createDataFrame(data, "k string, x long"), ["k"], ["x"]).collect()
    for k in ("hot", "b", None):
        mine = sorted((r.pos, r.x) for r in got if r.k == k)
        assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for kk, x in data if kk == k)
