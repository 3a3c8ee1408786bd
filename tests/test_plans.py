"""Plan checks: scans read one feature subtree; flatteners stay in the JVM and do not shuffle."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

FEATURE_OF = {
    "explicit_flat": "explicit_annotation", "labels_flat": "segment_label_annotations",
    "ocr_flat": "text_annotations", "boxes_scaled": "object_annotations",
    "person_frames": "person_detection_annotations", "logo_tracks": "logo_recognition_annotations",
    "face_attributes": "face_detection_annotations", "shot_labels": "shot_label_annotations",
    "chunks_min_duration": "shot_annotations", "speech_words": "speech_transcriptions",
}
FEATURES = set(FEATURE_OF.values())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(FEATURE_OF))
def test_scan_reads_one_feature(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # the whole schema
    try:
        p = plan(entry.queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = [line for line in p.splitlines() if "ReadSchema" in line or "Scan parquet" in line]
    text = " ".join(read)
    assert FEATURE_OF[name] in text
    for other in FEATURES - {FEATURE_OF[name]}:
        assert other not in text, (name, other)


@pytest.mark.parametrize("name", ["detected_features", "first_feature_result"])
def test_feature_presence_reads_one_leaf_of_each(spark, name):
    """Texts, boxes, vertices and words of whole documents once filled an executor's memory."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    try:
        p = plan(entry.queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = " ".join(line for line in p.splitlines() if "ReadSchema" in line or "Scan parquet" in line)
    assert all(f in read for f in FEATURES)
    for deep in ("vertices", "normalized_bounding_box", "landmarks", "words", "nanos", "segments", "attributes"):
        assert deep not in read, deep


def test_polygon_lookup_reads_vertices_once(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    try:
        p = plan(entry.queries()["polygon_at_time"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in p.split("== Initial Plan ==")[-1].splitlines() if "ReadSchema" in line and "text_annotations" in line]
    assert len(scans) == 3 and sum("vertices" in line for line in scans) == 1   # times for widths and tiles, polygons for hits


@pytest.mark.parametrize("name", ["explicit_flat", "labels_flat", "ocr_all_segments", "boxes_scaled",
                                  "landmarks_wide", "speech_words"])
def test_flatteners_do_not_shuffle_or_leave_jvm(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "Exchange" not in p and "Python" not in p and "ArrowEvalPython" not in p


@pytest.mark.parametrize("name", ["ocr_min_frames", "labels_ranked", "text_tracks", "track_segments",
                                  "track_segments_merged"])
def test_orders_and_merges_inside_a_document_do_not_shuffle(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "Exchange" not in p and "rangepartitioning" not in p


def test_merge_intervals_deals_rows_once(spark):
    from shotgrid.operators import summaries
    df = spark.range(10).selectExpr("'k' AS k", "id * 1.0D AS start", "id * 1.5D AS end")
    p = plan(summaries.merge_intervals(df, ["k"]))
    assert "Range (" not in p                # the rows were dealt and merged to stored islands
    windows = [line for line in p.split("== Initial Plan ==")[-1].splitlines() if "Window [" in line]
    assert windows and sum("_g#" in line for line in windows) >= len(windows) // 2   # of groups, but for the top of the tree


def test_single_part_videos_need_no_exchange(spark):
    from shotgrid.operators import chunks
    from shotgrid.plans import queries
    p = plan(chunks.min_duration_chunks(queries._shot_parts(spark, SF).where("n_parts = 1"), 60.0))
    assert "Exchange" not in p
