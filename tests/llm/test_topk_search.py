from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotgrid.llm import topk_search as K

LONG = 2 ** 63 - 1
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5, every=50):
    whole = [(i, v, [math.floor(256 * x) for x in e]) for i, (v, e) in enumerate(rows)
             if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q, a in whole:
        if q is None or q % every:
            continue
        scores = [(-max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(a, b)))), v is None, v or 0, v)
                  for j, v, b in whole if j != i]
        out += [(q, r + 1, v, -s) for r, (s, _, _, v) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def check(spark, rows):
    got = [tuple(r) for r in K.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()]
    assert order(got) == order(brute(rows))


def test_spread_lengths(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (rng.lognormal(0, 1.5) * (centres[i % 8] + 0.2 * rng.normal(size=12))).tolist()) for i in range(3000)]
    check(spark, rows)


def test_every_way_is_taken_and_keeps_the_result():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    v = np.floor(256 * (centres[rng.integers(0, 40, 6000)] + 0.05 * rng.normal(size=(6000, 16))) *
                 rng.choice([0.2, 1.0, 3.0], 6000)[:, None])
    rows, none = np.arange(6000), np.zeros(6000, np.uint8)
    queries = K.Queries(rows[::50], rows[::50], v[::50], 5)
    by_length = np.argsort(-np.linalg.norm(v, axis=1), kind="stable")
    for i in range(0, 6000, 500):
        part = by_length[i:i + 500]
        queries.meet(K.Bucket(np.linalg.norm(v[part], axis=1).max() * (1 + 1e-12), rows[part], rows[part], none[part], v[part]))
    assert all(queries.ways.values()), queries.ways
    for q, row in enumerate(rows[::50]):
        scores = (v @ v[row]).astype(np.int64)
        scores[row] = -2 ** 50
        want = np.lexsort((rows, -scores))[:5]
        mine = queries.best[queries.best[:, 0] == q]
        assert mine[:, 3].tolist() == want.tolist() and mine[:, 1].tolist() == scores[want].tolist()


def test_ties_repeats_nulls_and_widths(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(0, 400)]             # one hot vector
    rows += [(50, [0.5, -0.25, 0.125]), (50, [1.0, 0.0, 0.0]), (None, [0.5, -0.25, 0.125]), (None, [2.0, 0.0, 0.0])]
    rows += [(100, None), (150, [0.1, None, 0.2]), (200, [float("nan"), 0.0, 0.0]), (250, [float("inf"), 0.0, 0.0])]
    rows += [(300, []), (350, [0.5]), (-50, [-1.0, 0.0, 0.0, 4.0]), (401, [0.0, 0.0, 0.0])]
    check(spark, rows)


def test_huge_components_are_exact(spark):
    rows = [(0, [2.0 ** 40, 1.0]), (1, [2.0 ** 40, 3.0]), (2, [2.0 ** 40, 2.0]), (50, [1e300, 1.0]), (3, [1e308, 1.0]),
            (4, [-(2.0 ** 40), 0.5]), (5, [300.0, 0.3])]
    kept = [r for r in rows if r[0] != 3]                                # 256 * 1e308 is not finite
    got = [tuple(r) for r in K.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()]
    assert order(got) == order(brute(kept))


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(0, [1.0])], [(0, [1.0]), (1, [2.0])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("clash")).withColumn("norm", F.lit(1))
    got = [tuple(r) for r in K.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert order(got) == order(brute(rows))


def test_no_limit_of_groups_changes_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(2000)]
    monkeypatch.setattr(K, "GROUP_BYTES", 1024)                          # groups of some 16 queries
    check(spark, rows)
