"""Folding of flat events into annotation documents: what is shuffled, and what the JSON source reads."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from shotgrid.sources import fixtures as fx


def events(spark, path, rows):
    """Rows of (event_id, seconds, user_id, event_type, value, props)."""
    start = datetime(2024, 1, 1)
    spark.createDataFrame(
        [(i, start + timedelta(seconds=s), u, t, v, p) for i, s, u, t, v, p in rows],
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    ).write.parquet(f"{path}/events.parquet")
    return str(path)


ROWS = [(2, 30, 1, "click", 700.0, '{"k": 3}'), (1, 10, 1, "view", 100.0, '{"k": 2}'), (3, 20, 1, "click", 300.0, '{"k": 1}'),
        (3, 20, 1, "click", 300.0, '{"k": 1}'), (4, 40, 1, None, 900.0, '{"k": 4}'), (5, 50, 2, "view", 50.0, None),
        (6, 60, None, "view", 50.0, '{"k": 1}')]


def test_only_flat_events_are_shuffled(spark, tmp_path):
    sf = events(spark, tmp_path, ROWS)
    plan = fx.event_documents(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 1, plan
    assert "Join" not in plan, plan


def test_documents_of_repeated_and_null_events(spark, tmp_path):
    docs = {r["file"]: r["annotation_results"] for r in fx.event_documents(spark, events(spark, tmp_path, ROWS)).collect()}
    assert sorted(docs) == ["annotations/1.json", "annotations/2.json"]     # no document without a user
    first, second = docs["annotations/1.json"]
    assert [s["end_time_offset"]["seconds"] for s in first["shot_annotations"]] == [20, 20, 30, 40]
    assert second["shot_annotations"] is None
    assert [x["text"] for x in first["text_annotations"]] == [None, "click", "view"]
    clicks = second["object_annotations"][1]
    assert [f["time_offset"]["seconds"] for f in clicks["frames"]] == [20, 20, 30]
    assert clicks["confidence"] == 1.0
    faces = second["face_detection_annotations"]
    assert [x["thumbnail"] for x in faces] == [None, "click-1", "view-1"]
    assert [len(t["timestamped_objects"]) for x in second["logo_recognition_annotations"][1:2] for t in x["tracks"]] == [1, 2]


def test_json_source_reads_only_shots(spark, tmp_path):
    fx.event_documents(spark, events(spark, tmp_path, ROWS)).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # the whole schema
    try:
        lines = fx.annotation_lines(spark.read.parquet(f"{tmp_path}/docs"))
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "shot_annotations" in plan
    assert "text_annotations:" not in plan and "face_detection" not in plan
    ends = F.from_json("value", "annotation_results array<struct<shot_annotations array<struct<end_time_offset struct<seconds long>>>>>")
    got = [r[0] for r in lines.select(ends["annotation_results"]["shot_annotations"][0]["end_time_offset"]["seconds"].alias("s"))
           .where(F.size("s") > 0).collect()]
    assert got == [[20, 20, 30, 40]]


def test_stored_documents_lie_in_small_row_groups(spark, tmp_path):
    """A reader unpacks thousands of rows of a row group at once; here a row is a whole document."""
    rows = [(i, i, i % 600, "click", 900.0, '{"k": 19}') for i in range(1200)] + \
        [(i, i, 600 + i % 30, "view", 900.0, '{"k": 19}') for i in range(1200, 13200)]
    docs = fx.stored_documents(spark, events(spark, tmp_path, rows), "events")
    groups = []
    for f in docs.inputFiles():
        m = pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata
        groups += [m.row_group(i).num_rows for i in range(m.num_row_groups)]
    assert sum(groups) == docs.count() == 630
    assert max(groups) <= fx.GROUP_ROWS < 630


def test_large_documents_lie_in_row_groups_of_bounded_bytes(spark, tmp_path):
    docs = spark.range(200, numPartitions=1).selectExpr(
        "concat('f', id) AS file", "transform(sequence(1, 60000), i -> xxhash64(id, i)) AS annotation_results")   # 0.5 MB each
    fx.write_documents(docs, f"{tmp_path}/docs")
    (f,) = spark.read.parquet(f"{tmp_path}/docs").inputFiles()
    m = pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata
    sizes = [m.row_group(i).total_byte_size for i in range(m.num_row_groups)]
    assert m.num_rows == 200 and max(sizes) < 1.5 * fx.GROUP_BYTES
