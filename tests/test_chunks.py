"""WIN-1..4: minimum-length chunk merge (FIXTURES F5 a-c) and properties."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import seg
from shotgrid.operators import chunks


def shots_doc(shots, uri="/b/v.mp4"):
    return {"annotation_results": [{"input_uri": uri,
                                    "shot_annotations": [seg(a, b) for a, b in shots]}]}


def run(docs_from, shots, min_seconds=5.0):
    scan = docs_from(shots_doc(shots))
    rows = chunks.min_duration_chunks(scan.good, min_seconds).orderBy("chunk").collect()
    return [(r.chunk, r.t1, r.t2) for r in rows]


def test_merge_and_tail_drop(docs_from):  # F5 a
    assert run(docs_from, [(0, 2), (2, 4), (4, 7), (7, 8)]) == [(1, 0.0, 7.0)]


def test_strict_compare(docs_from):  # F5 b
    assert run(docs_from, [(0, 5), (5, 11)]) == [(1, 0.0, 11.0)]


def test_gap_swallowed(docs_from):  # F5 c
    assert run(docs_from, [(0, 6), (10, 12), (20, 26)]) == [(1, 0.0, 6.0), (2, 10.0, 26.0)]


def test_manifest_names_and_file_numbering(spark, docs_from):
    doc = {"annotation_results": [
        {"input_uri": "/bk/a/v.mp4", "shot_annotations": [seg(0, 6), seg(6, 13)]},
        {"input_uri": "/bk/a/v.mp4", "shot_annotations": [seg(0, 9)]}]}
    scan = docs_from(doc)
    c = chunks.min_duration_chunks(scan.good, 5.0)
    per_result = sorted((r["index"], r["object_name"]) for r in chunks.chunk_manifest(c).collect())
    assert per_result == [(1, "CSA/a/v.mp4/chunks - 1 - 0.0 - 6.0.mp4"),
                          (1, "CSA/a/v.mp4/chunks - 1 - 0.0 - 9.0.mp4"),
                          (2, "CSA/a/v.mp4/chunks - 2 - 6.0 - 13.0.mp4")]
    per_file = sorted(r["index"] for r in chunks.chunk_manifest(c, numbering="file").collect())
    assert per_file == [1, 2, 3]
    src = chunks.chunk_manifest(c).select("video_source", "video_blobname").first()
    assert (src.video_source, src.video_blobname) == ("gs://bk/a/v.mp4", "a/v.mp4")


def test_shots_enumerated(docs_from):
    scan = docs_from(shots_doc([(0, 2), (2, 4.5)]))
    rows = chunks.shots_enumerated(scan.good).orderBy("shot").collect()
    assert [(r.shot, r.start, r.end, r.duration) for r in rows] == [(1, 0.0, 2.0, 2.0),
                                                                      (2, 2.0, 4.5, 2.5)]


def reference_rule(shots, m):
    out, start = [], None
    for a, b in shots:
        if start is None:
            start = a
        if b - start > m:
            out.append((start, b))
            start = None
    return out


durations = st.lists(st.tuples(st.integers(0, 4), st.integers(1, 9)), min_size=0, max_size=25)


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(durations, st.integers(0, 12))
def test_property_matches_rule(docs_from, gaps_lens, m):
    t, shots = 0, []
    for gap, length in gaps_lens:
        a = t + gap
        shots.append((a, a + length))
        t = a + length
    got = [(a, b) for _, a, b in run(docs_from, shots, float(m))] if shots else []
    expected = reference_rule([(float(a), float(b)) for a, b in shots], float(m))
    assert got == expected
    starts = {float(a) for a, _ in shots}
    ends = {float(b) for _, b in shots}
    for i, (a, b) in enumerate(got):
        assert b - a > m and a in starts and b in ends
        if i:
            assert a >= got[i - 1][1]
