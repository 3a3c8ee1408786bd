"""JN-3..8: interval and as-of lookups (FIXTURES F5 i, j) against brute force."""

from __future__ import annotations

import random

import pytest

from conftest import off, seg
from shotgrid import schema as S
from shotgrid.operators import timeline
from shotgrid.plans.ranges import range_join


def object_doc(times, xs, span=None):
    frames = [{"time_offset": off(t), "normalized_bounding_box": {
        "left": x, "top": 0.0, "right": x + 1, "bottom": 1.0}} for t, x in zip(times, xs)]
    a, b = span if span else (min(times), max(times))
    return {"annotation_results": [{"input_uri": "/b/v.mp4", "object_annotations": [
        {"entity": {"description": "cat"}, "confidence": 0.9, "segment": seg(a, b),
         "frames": frames}]}]}


def probe_df(spark, ts, uri="/b/v.mp4"):
    return spark.createDataFrame([(uri, float(t)) for t in ts], "input_uri string, t double")


def brute_box(times, xs, t, interpolate):
    n = len(times)
    for i, ti in enumerate(times):
        if ti > t:
            if i == 0:
                return None
            if not interpolate or i == 1 or i == n - 1:
                return xs[i - 1]
            r = (t - times[i - 1]) / (ti - times[i - 1])
            return xs[i - 1] + (xs[i] - xs[i - 1]) * r
    return None


def test_interpolation_f5_i(spark, docs_from):  # F5 i
    times, xs = [0, 1, 2, 3, 4], [0, 10, 20, 30, 40]
    scan = docs_from(object_doc(times, [x for x in xs], span=(-1, 4)))
    probes = probe_df(spark, [0.5, 1.5, 2.5, 3.5, 4, -1])
    got = {r.t: r.x for r in timeline.box_at_time(scan.good, probes, True, w=1, h=1).collect()}
    assert got == {0.5: 0.0, 1.5: 15.0, 2.5: 25.0, 3.5: 30.0, 4.0: None, -1.0: None}


def test_box_random_vs_brute_force(spark, docs_from):
    rnd = random.Random(7)
    times = sorted({rnd.randint(0, 60) for _ in range(12)})
    xs = [rnd.random() for _ in times]
    scan = docs_from(object_doc(times, xs))
    ts = [rnd.uniform(min(times), max(times)) for _ in range(40)] + times
    probes = probe_df(spark, ts)
    for interp in (False, True):
        got = {r.t: r.x for r in timeline.box_at_time(scan.good, probes, interp, w=1, h=1).collect()}
        for t in ts:
            exp = brute_box(times, xs, t, interp)
            assert (got[t] is None and exp is None) or abs(got[t] - exp) < 1e-12
            if interp and exp is not None:  # property: value lies between neighbours
                assert min(xs) - 1e-12 <= got[t] <= max(xs) + 1e-12


def test_likelihood_clamp_f5_j(spark, docs_from):  # F5 j
    doc = {"annotation_results": [{"input_uri": "/b/v.mp4", "explicit_annotation": {"frames": [
        {"time_offset": off(t), "pornography_likelihood": v} for t, v in ((1, "A"), (2, "B"), (3, "C"))]}}]}
    scan = docs_from(doc)
    got = {r.t: r.likelihood for r in
           timeline.likelihood_at_time(scan.good, probe_df(spark, [0, 1, 2.5, 3])).collect()}
    assert got == {0.0: "A", 1.0: "A", 2.5: "B", 3.0: ""}


def test_timeline_positions_of_objects_persons_and_explicit_frames(spark, docs_from):  # PRJ-4
    def track(conf):
        return {"confidence": conf, "segment": seg(2, 5)}

    scan = docs_from({"annotation_results": [{
        "input_uri": "/b/v.mp4",
        "object_annotations": [{"entity": {"description": "cat"}, **track(0.9)},
                               {"entity": {"description": "dog"}, **track(0.5)}],
        "person_detection_annotations": [{"tracks": [track(0.8), track(0.9)]}, {"tracks": []}],
        "explicit_annotation": {"frames": [{"time_offset": off(4), "pornography_likelihood": "A"}]}}]})

    def rows(build, length):
        lengths = spark.createDataFrame([("/b/v.mp4", length, 1)], "input_uri string, length double, start long")
        return [tuple(r)[1:] for r in build(scan.good, lengths).collect()]

    assert rows(timeline.object_timeline_pct, 8.0) == [(0, "cat", 25.0, 37.5)]     # over, not at, the threshold
    assert rows(timeline.person_timeline_pct, 8.0) == [(0, 25.0, 37.5)]            # a person's first track
    assert rows(timeline.explicit_timeline_pct, 8.0) == [(0, "A", 50.0)]
    for length in (0.0, None):
        assert rows(timeline.object_timeline_pct, length) == [(0, "cat", None, None)]
    none = spark.createDataFrame([], "input_uri string, length double")
    assert timeline.person_timeline_pct(scan.good, none).count() == 0


def test_shot_at_time_inclusive(spark, docs_from):
    doc = {"annotation_results": [{"input_uri": "/b/v.mp4",
                                   "shot_annotations": [seg(0, 2), seg(2, 5)]}]}
    scan = docs_from(doc)
    got = sorted((r.t, r.shot) for r in
                 timeline.shot_at_time(scan.good, probe_df(spark, [1, 2, 6])).collect())
    assert got == [(1.0, 1), (2.0, 1), (2.0, 2)]


def test_landmarks_edge_and_interp(spark, docs_from):
    def fr(t, pts):
        return {"time_offset": off(t), "normalized_bounding_box": {},
                "landmarks": [{"name": n, "point": {"x": x, "y": 0.0}} for n, x in pts]}
    frames = [fr(0, [("nose", 0.0)]), fr(1, [("nose", 1.0), ("left_eye", 1.0)]),
              fr(2, [("nose", 3.0), ("left_eye", 2.0)]), fr(3, [("nose", 5.0)]),
              fr(4, [("nose", 6.0)])]
    doc = {"annotation_results": [{"input_uri": "/b/v.mp4", "person_detection_annotations": [
        {"tracks": [{"segment": seg(0, 4), "confidence": 0.9, "timestamped_objects": frames}]}]}]}
    scan = docs_from(doc)
    rows = timeline.landmarks_at_time(scan.good, probe_df(spark, [0.5, 1.5, 2.5]), w=1, h=1).collect()
    got = sorted((r.t, r.landmark, r.x) for r in rows)
    assert got == [(0.5, "nose", 0.0),                      # first gap: earlier frame
                   (1.5, "left_eye", 1.5), (1.5, "nose", 2.0),
                   (2.5, "nose", 4.0)]                     # left_eye missing on the right


def test_polygon_first_covering_segment(spark, docs_from):
    def frame(t, x):
        return {"time_offset": off(t), "rotated_bounding_box": {"vertices": [
            {"x": x, "y": 0.0}, {"x": x + 1, "y": 0.0}, {"x": x + 1, "y": 1.0}, {"x": x, "y": 1.0}]}}
    doc = {"annotation_results": [{"input_uri": "/b/v.mp4", "text_annotations": [
        {"text": "T", "segments": [
            {"segment": seg(0, 10), "confidence": 0.9,
             "frames": [frame(t, x) for t, x in ((0, 0), (1, 10), (2, 20), (3, 30))]},
            {"segment": seg(0, 10), "confidence": 0.9, "frames": [frame(0, 100), frame(9, 100)]}]}]}]}
    scan = docs_from(doc)
    r = timeline.polygon_at_time(scan.good, probe_df(spark, [1.5]), w=1, h=1).first()
    assert (r.x0, r.x1, r.y2) == (15.0, 16.0, 1.0)


def test_likelihood_without_frames_is_empty(spark, docs_from):  # JN-8
    scan = docs_from({"annotation_results": [{"input_uri": "/b/v.mp4"}]})
    got = [(r.t, r.likelihood) for r in timeline.likelihood_at_time(scan.good, probe_df(spark, [0, 5])).collect()]
    assert sorted(got) == [(0.0, ""), (5.0, "")]


def logo_doc(*tracks):
    def fr(t, x):
        return {"time_offset": off(t), "normalized_bounding_box": {"left": x, "top": 0.0, "right": x + 1, "bottom": 1.0}}
    return {"annotation_results": [{"input_uri": "/b/v.mp4", "logo_recognition_annotations": [
        {"entity": {"entity_id": "e", "description": "brand"}, "tracks": [
            {"segment": seg(a, b), "confidence": c, "timestamped_objects": [fr(t, x) for t, x in frames]}
            for a, b, c, frames in tracks]}]}]}


def test_logo_uses_the_earliest_kept_track_covering_t(spark, docs_from):  # JN-4 / JN-5 on logos
    doc = logo_doc((0, 4, 0.2, [(0, 50.0), (4, 50.0)]), (0, 4, 0.9, [(0, 1.0), (1, 2.0), (4, 3.0)]),
                   (2, 9, 0.9, [(2, 10.0), (5, 11.0), (9, 12.0)]))
    scan = docs_from(doc)
    probes = probe_df(spark, [0.5, 3, 6, 9, 20])
    got = {r.t: r.x for r in timeline.box_at_time(scan.good, probes, False, "logo_recognition_annotations", 1, 1).collect()}
    assert got == {0.5: 1.0, 3.0: 2.0, 6.0: 11.0, 9.0: None}  # 3 lies in two tracks; at 9 the track has no later frame


def test_logo_and_object_segments(spark, docs_from):  # AGG-1, AGG-3
    from shotgrid.operators import summaries
    scan = docs_from(logo_doc((0, 4, 0.9, []), (2, 6, 0.9, []), (6, 8, 0.9, []), (7, 9, 0.3, [])))
    feature = "logo_recognition_annotations"
    r = summaries.track_segments(scan.good, 0.5, feature).first()
    assert (r.name, r.n_tracks, r.segments) == ("brand", 3, "0.0-4.0;2.0-6.0;6.0-8.0")
    rows = summaries.track_segments_merged(scan.good, 0.5, feature).collect()
    assert sorted((r.seg_start, r.seg_end, r.n_merged) for r in rows) == [(0.0, 6.0, 2), (6.0, 8.0, 1)]


def test_viewer_numbers_are_64_bit(spark, docs_from):  # FLT-3, NST-11, SCL-13
    from shotgrid.operators import flatten
    frame = {"time_offset": off(1), "rotated_bounding_box": {"vertices": [{"x": 0.1, "y": 0.2}, {"x": 0.5, "y": 0.25}]}}
    doc = {"annotation_results": [{"input_uri": "/b/v.mp4", "face_detection_annotations": [{"tracks": [
        {"segment": seg(0, 1), "confidence": 0.7, "attributes": [{"name": "smiling", "confidence": 0.7},
                                                                 {"name": "glasses", "confidence": 0.29}]}]}],
        "text_annotations": [{"text": "T", "segments": [
            {"segment": seg(0, 9), "confidence": 0.1, "frames": []},
            {"segment": seg(1, 2), "confidence": 0.9, "frames": [frame]}]}]}]}
    scan = docs_from(doc)
    face = flatten.face_attributes(scan.good, 0.7 - 1e-12).first()
    assert (face.smiling, face.glasses) == (70, 28) and flatten.face_attributes(scan.good, 0.7).count() == 0
    assert flatten.text_tracks(scan.good).first().item_id == "12" + "80100" + "400125"


def test_labels_at_time_gives_one_row_where_segments_meet(spark, docs_from):  # JN-3
    def label(name, *spans):
        return {"entity": {"description": name}, "segments": [
            {"confidence": c, "segment": seg(a, b)} for a, b, c in spans]}

    rnd = random.Random(3)
    many = [(float(a), float(a + rnd.randint(0, 4)), 0.9) for a in (rnd.randint(0, 40) for _ in range(25))]
    labels = [label("meet", (0, 2, 0.9), (2, 5, 0.8), (1, 3, 0.7)), label("apart", (6, 7, 0.9), (0, 1, 0.9)),
              label("low", (0, 9, 0.0)), label("none"), label("back", (5, 4, 0.9)), label("many", *many)]
    scan = docs_from({"annotation_results": [{"input_uri": "/b/v.mp4", "shot_label_annotations": labels}]})
    ts = [0.0, 1.0, 2.0, 2.5, 5.0, 5.5, 6.5, 8.0, *(x / 2 for x in range(20, 92))]
    got = sorted((r.t, r.name) for r in timeline.labels_at_time(scan.good, probe_df(spark, ts)).collect())
    spans = {"meet": [(0, 5)], "apart": [(0, 1), (6, 7)], "many": [(a, b) for a, b, _ in many]}
    assert got == sorted((t, n) for t in ts for n, s in spans.items() if any(a <= t <= b for a, b in s))


def test_payload_stays_out_of_the_range_join(spark, docs_from):  # JN-4, 5, 7
    scan = docs_from(object_doc([0, 1, 2], [0.0, 1.0, 2.0]))
    tracks = timeline._box_tracks(scan.good, "object_annotations", 1, 1)
    tiles = timeline._tile_times(tracks, ["input_uri", "track", "part"])
    assert {f.dataType.simpleString() for f in tiles.schema.fields} <= {"string", "int", "double", "boolean"}


TRACK = "input_uri string, text_pos int, segment_pos int, span_start double, span_end double, fr array<struct<t double>>"


@pytest.mark.parametrize("size", [1, 3, timeline.BLOCK])
def test_blocks_of_tiles_give_the_hits_of_single_tiles(spark, size):  # JN-6
    """Also with frames out of order, twice, outside the span or missing, and for repeated keys and probes."""
    rnd = random.Random(7)
    rows = [("v", 0, 0, 0.0, 9.0, []), ("v", 0, 1, 0.0, 9.0, None), ("v", 0, 2, 5.0, 4.0, [(4.5,)]), ("v", 0, 3, 4.0, 4.0, [(4.0,)]),
            ("v", 0, 3, 2.0, 6.0, [(3.0,), (5.0,)]), (None, 0, 4, 0.0, 9.0, [(1.0,)])]
    for i in range(60):
        start, frames = rnd.randint(0, 10), [float(rnd.randint(0, 24)) for _ in range(rnd.choice([1, 2, 5, 9, 150]))]
        rows.append((rnd.choice("vw"), 1, i, float(start), float(start + rnd.choice([0, 3, 12])),
                     [(x,) for x in (frames if i % 3 == 0 else sorted(frames))]))
    tracks = spark.createDataFrame(rows, TRACK)
    ts = [x / 2 for x in range(-2, 50)] + [4.0, 4.0]
    probes = spark.createDataFrame([(v, t, 1) for v in ("v", "w", "u", None) for t in ts], "input_uri string, t double, x int")
    keys = ["input_uri", "text_pos", "segment_pos"]
    tiles = range_join(probes, timeline._tile_times(tracks, keys), ["input_uri"], "t", "ta", "tb", closed="closed")
    out = [*keys, "t", "j", "t_a", "t_b"]
    got, exp = (sorted(map(tuple, d.select(*out).collect()), key=repr)
                for d in (timeline._tiles_at(probes, tracks, keys, size), tiles))
    assert got == exp and len(got) > 500


def test_tiles_of_a_long_text_are_joined_in_blocks(spark):  # JN-6
    tracks = spark.createDataFrame([("v", 0, s, 0.0, 999.0, [(float(i),) for i in range(1000)]) for s in range(3)], TRACK)
    blocks = timeline._tile_blocks(tracks, ["input_uri", "text_pos", "segment_pos"], timeline.BLOCK).collect()
    assert len(blocks) == 3 * 16                                    # of 1,001 tiles each
    assert all(len(b.x) <= timeline.BLOCK + 1 for b in blocks)


def test_polygon_lookup_sends_no_row_for_every_tile(spark, docs_from):  # JN-6
    scan = docs_from({"annotation_results": [{"input_uri": "/b/v.mp4", "text_annotations": [{"text": "T", "segments": [
        {"segment": seg(0, 9), "confidence": 0.9, "frames": []}]}]}]})
    plan = timeline.polygon_at_time(scan.good, probe_df(spark, [1.0]))._jdf.queryExecution().optimizedPlan().toString()
    assert "closed" not in plan and "rotated_bounding_box" in plan


def test_polygons_with_times_read_apart(spark, tmp_path):  # JN-6
    def frame(t):
        return {"time_offset": off(t), "rotated_bounding_box": {"vertices": [{"x": t / 100, "y": i / 10} for i in range(4)]}}

    texts = [{"text": "T", "segments": [{"segment": seg(0, 9), "confidence": c, "frames": [frame(t) for t in ts]}
                                        for c, ts in ((0.9, (1, 2, 4, 8)), (0.2, (1, 2)), (0.8, ()))]}, {"text": None}, None]
    rows = [("a", [{"input_uri": "v", "text_annotations": texts}]), ("b", [{"input_uri": "w"}, {"text_annotations": texts}]),
            ("c", [{"input_uri": "w", "text_annotations": []}, {"input_uri": "w", "text_annotations": texts}]), ("d", None)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, f"file STRING, {S.ANNOTATION_DDL}").write.parquet(path)
    docs, times = spark.read.parquet(path), spark.read.schema(S.TEXT_TIMES_DDL).parquet(path)
    probes = probe_df(spark, [0, 1, 3, 5, 8, 9, 9.5], "v").union(probe_df(spark, [3], "w"))
    got, exp = (sorted(map(tuple, timeline.polygon_at_time(docs, probes, docs_times=d).collect()), key=repr) for d in (times, None))
    assert got == exp and [r[1] for r in got] == [0.0, 1.0, 3.0, 5.0, 8.0, 9.0]
