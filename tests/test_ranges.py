"""plans.ranges.range_join against a brute-force nested loop."""

from __future__ import annotations

import random

import pytest

from shotgrid import schema as S
from shotgrid.operators import timeline
from shotgrid.plans.ranges import bucketed, level_of, range_join


@pytest.mark.parametrize("inclusive,how", [(True, "inner"), (False, "inner"), (False, "left")])
def test_range_join_matches_brute_force(spark, inclusive, how):
    rnd = random.Random(11)
    intervals = []
    for i in range(120):
        v = f"v{rnd.randint(0, 3)}"
        a = round(rnd.uniform(-20, 40), 1)
        length = rnd.choice([0.0, 0.0, 0.3, 1.0, 2.5, 9.0, 35.0, -1.0, 400.0, 3000.0])
        intervals.append((v, i, a, round(a + length, 1)))
    probes = [(f"v{rnd.randint(0, 4)}", float(round(rnd.uniform(-25, 3100), 1))) for _ in range(300)]
    probes += [(v, a) for v, _, a, _ in intervals[:30]] + [(v, b) for v, _, _, b in intervals[30:60]]
    p = spark.createDataFrame(probes, "input_uri string, t double")  # some probes twice
    iv = spark.createDataFrame(intervals, "input_uri string, id int, s double, e double")
    got = sorted(((r.input_uri, r.t, r.id) for r in
                  range_join(p, iv, ["input_uri"], "t", "s", "e", how=how, end_inclusive=inclusive).collect()), key=repr)
    exp = []
    for v, t in probes:
        hits = [i for (w, i, a, b) in intervals
                if w == v and a <= t and (t <= b if inclusive else t < b)]
        exp += [(v, t, i) for i in hits] or ([(v, t, None)] if how == "left" else [])
    assert got == sorted(exp, key=repr)


def test_closed_column_decides_row_by_row(spark):
    iv = spark.createDataFrame([("v", 1, 0.0, 2.0, False), ("v", 2, 2.0, 5.0, True), ("v", 3, 5.0, 5.0, False)],
                               "k string, id int, s double, e double, c boolean")
    p = spark.createDataFrame([("v", t) for t in (0.0, 2.0, 5.0)], "k string, t double")
    got = sorted((r.t, r.id) for r in range_join(p, iv, ["k"], "t", "s", "e", closed="c").collect())
    assert got == [(0.0, 1), (2.0, 2), (5.0, 2)]


def test_one_long_gap_stays_linear(spark):
    """1,000 gaps of 0.04 s and one of ten hours: two buckets an interval, one copy of a probe per width."""
    rows = [("v", i * 0.04, (i + 1) * 0.04) for i in range(1000)] + [("v", 40.0, 36_040.0)]
    iv = spark.createDataFrame(rows, "k string, s double, e double")
    assert bucketed(iv, "s", "e").count() <= 3 * len(rows)
    assert iv.select(level_of(iv.e - iv.s)).distinct().count() <= 3
    p = spark.createDataFrame([("v", t / 10) for t in range(0, 360_000, 7)], "k string, t double")
    assert range_join(p, iv, ["k"], "t", "s", "e", end_inclusive=False).count() == p.where("t < 36040").count()


def test_building_a_lookup_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    probes = spark.range(5).selectExpr("'v' AS input_uri", "id * 1.0D AS t")
    docs = spark.createDataFrame([], S.annotation_schema(None)).selectExpr("'f' AS file", "annotation_results")
    spark.sparkContext.setJobGroup("building", "no job is expected")
    for build in (timeline.box_at_time, timeline.labels_at_time, timeline.likelihood_at_time, timeline.polygon_at_time,
                  timeline.landmarks_at_time, timeline.shot_at_time):
        build(docs, probes)
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
