"""AGG-*, catalogue and scalar rules (FIXTURES F5 k-o)."""

from __future__ import annotations

from conftest import off, seg
from shotgrid.functions import scalars as X
from shotgrid.operators import catalog, summaries


def test_tracks_not_merged_f5_k(docs_from):  # F5 k
    doc = {"annotation_results": [{"input_uri": "/b/v.mp4", "object_annotations": [
        {"entity": {"description": "cat"}, "confidence": 0.9, "segment": seg(0, 5), "frames": []},
        {"entity": {"description": "cat"}, "confidence": 0.9, "segment": seg(3, 8), "frames": []}]}]}
    r = summaries.track_segments(docs_from(doc).good, 0.5).first()
    assert (r.name, r.n_tracks, r.segments) == ("cat", 2, "0.0-5.0;3.0-8.0")


def test_merge_intervals(spark):
    df = spark.createDataFrame([("v", "a", 0.0, 5.0), ("v", "a", 3.0, 8.0), ("v", "a", 8.0, 9.0),
                                ("v", "a", 10.0, 11.0)], "input_uri string, name string, start double, end double")
    got = sorted((r.seg_start, r.seg_end, r.n_merged)
                 for r in summaries.merge_intervals(df, ["input_uri", "name"]).collect())
    assert got == [(0.0, 8.0, 2), (8.0, 9.0, 1), (10.0, 11.0, 1)]  # touching ends do not merge


def test_person_segments_zero(docs_from):
    doc = {"annotation_results": [{"input_uri": "/b/v.mp4", "shot_annotations": [seg(0, 1)]}]}
    r = summaries.person_segments(docs_from(doc).good).first()
    assert (r.key, r.n_tracks, r.segments) == ("person", 0, "")


def test_likelihood_buckets_count(docs_from):
    doc = {"annotation_results": [{"input_uri": "/b/v.mp4", "explicit_annotation": {"frames": [
        {"time_offset": off(1), "pornography_likelihood": "LIKELY"},
        {"time_offset": off(2), "pornography_likelihood": "4"},
        {"time_offset": off(3), "pornography_likelihood": "WEIRD"}]}}]}
    got = {r.likelihood: (r.n_frames, r.times) for r in
           summaries.likelihood_buckets(docs_from(doc).good).collect()}
    assert got["LIKELY"] == (2, "1.0;2.0") and got["OTHER"] == (1, "3.0")
    assert got["VERY_LIKELY"] == (0, "") and len(got) == 6


def test_language_code_last_wins_f5_l(spark):  # F5 l
    df = spark.createDataFrame([("gs://b/fr-FR/pt-BR.mp4",), ("gs://b/x.mp4",)], "u string")
    assert [r[0] for r in df.select(X.language_code("u")).collect()] == ["pt-BR", "en-US"]


def test_context_text_f5_m(spark):  # F5 m
    df = spark.createDataFrame([("a" * 1024,), ("b" * 1025,)], "t string")
    assert [len(r[0]) for r in df.select(X.context_text("t")).collect()] == [1024, 1000]


def results_frame(spark):
    rows = [("2", "ERROR"), ("10", "ERROR: quota"), ("1", None), ("3", "fine"), ("11", "ok")]
    return spark.createDataFrame(
        [(i, "1.0", "2.0", "movie", "gs://in/movie.mp4", d, "t", f"u{i}") for i, d in rows],
        "index string, time_start string, time_stop string, video_blobname string, "
        "video_source string, description string, update_time string, uri string")


def test_description_filter_and_order_f5_n_o(spark):  # F5 n, o
    got = [r["index"] for r in catalog.movie_description(results_frame(spark), "movie").collect()]
    assert got == ["3", "10", "11"]
    top = catalog.top_rows(catalog.movie_description(results_frame(spark), "movie"), 2).collect()
    assert [r["index"] for r in top] == ["3", "10"]


def test_results_with_tags_inner(spark):
    out = spark.createDataFrame([("a", "d1"), ("b", "d2")], "uri string, description string")
    tags = spark.createDataFrame([("a", "s", "v", "1", "0.0", "1.0")],
                                 "uri string, video_source string, video_blobname string, "
                                 "index string, time_start string, time_stop string")
    rows = catalog.results_with_tags(out, tags, "2024-02-01 10:11:12").collect()
    assert len(rows) == 1 and rows[0].update_time == "2024-02-01 10:11:12"


def test_path_scalars(spark):
    df = spark.createDataFrame([("a/b.c/file.tar.gz",), ("dir/.bashrc",), ("noext",),
                                ("gs://bk/x/y.mp4",), ("http://h/x",)], "u string")
    rows = df.select(X.replace_extension("u", ".json").alias("r"), X.base_name("u").alias("b"),
                     X.split_gs_uri("u").alias("p"), X.audio_name("u").alias("a")).collect()
    assert [r.r for r in rows] == ["a/b.c/file.tar.json", "dir/.bashrc.json", "noext.json",
                                   "gs://bk/x/y.json", "http://h/x.json"]
    assert [r.b for r in rows] == ["b", "", "noext", "y", "x"]
    assert (rows[3].p.bucket, rows[3].p.blob) == ("bk", "x/y.mp4") and rows[4].p.bucket is None
    assert rows[3].a == "gs://bk/x/y.mp3"


def test_clean_json_and_feature_name(spark):
    df = spark.createDataFrame([("```json {'a': 1} ```", "2"), ("JSON", "OBJECT_TRACKING"),
                                ("x", "13")], "t string, f string")
    rows = df.select(X.clean_json("t").alias("c"), X.feature_name("f").alias("n")).collect()
    assert [r.c for r in rows] == [' {"a": 1} ', "", "x"]
    assert [r.n for r in rows] == ["SHOT_CHANGE_DETECTION", "OBJECT_TRACKING", "UNKNOWN"]


def test_request_manifest_no_join(spark):
    v = spark.createDataFrame([("gs://b/de-DE/clip.one.mp4",)], "input_uri string")
    rows = catalog.request_manifest(v, "work", "123.0", ["SHOT_CHANGE_DETECTION"]).collect()
    assert rows[0].output_uri == "gs://work/de-DE/SHOT_CHANGE_DETECTION/clip - 123.0.json"


def test_merge_intervals_random_vs_brute(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        k = rnd.choice(["a", "b", "c"])
        s = round(rnd.uniform(0, 200), 1)
        rows.append(("v", k, i, s, round(s + rnd.choice([0.0, 0.5, 2.0, 7.0, 30.0]), 1)))
    df = spark.createDataFrame(rows, "input_uri string, name string, pos int, start double, end double")
    exp = []
    for k in "abc":
        iv = sorted((s, e, p) for _, kk, p, s, e in rows if kk == k)
        cur = None
        for s, e, _ in iv:
            if cur is None or s >= cur[1]:
                if cur:
                    exp.append((k,) + tuple(cur))
                cur = [s, e, 1]
            else:
                cur[1], cur[2] = max(cur[1], e), cur[2] + 1
        exp.append((k,) + tuple(cur))
    for width in (None, 1.0, 13.0, 500.0):
        got = sorted((r.name, r.seg_start, r.seg_end, r.n_merged) for r in
                     summaries.merge_intervals(df, ["input_uri", "name"], order=["pos"],
                                               width=width).collect())
        assert got == sorted(exp)


def test_split_gs_uri_strict(spark):
    import pytest
    df = spark.createDataFrame([("http://x/y",)], "u string")
    with pytest.raises(Exception, match="invalid gs uri"):
        df.select(X.split_gs_uri("u", strict=True).alias("p")).collect()
