"""NST-*: flatteners on hand-made documents (FIXTURES F5 d-h and more)."""

from __future__ import annotations

from conftest import off, seg
from shotgrid import schema as S
from shotgrid.functions.scalars import offset_seconds
from shotgrid.operators import flatten


def text_doc(confs):
    return {"annotation_results": [{"input_uri": "/b/v.mp4", "text_annotations": [
        {"text": "hello", "segments": [{"segment": seg(i, i + 1), "confidence": c}
                                       for i, c in enumerate(confs)]}]}]}


def test_ocr_first_segment_only(docs_from):  # F5 d
    scan = docs_from(text_doc([0.2, 0.9]))
    assert flatten.ocr_flat(scan.good).count() == 0


def test_ocr_float_boundary(docs_from):  # F5 e: float32 0.3 > 0.3
    scan = docs_from(text_doc([0.3]))
    rows = flatten.ocr_flat(scan.good).collect()
    assert [(r.uri, r.start, r.stop, r.text_segment) for r in rows] == [
        ("/b/v.mp4", 0.0, 1.0, "hello")]


def label_doc(categories, confs):
    return {"annotation_results": [{"input_uri": "/b/v.mp4", "segment_label_annotations": [
        {"entity": {"description": "dog"},
         "category_entities": [{"description": c} for c in categories],
         "segments": [{"segment": seg(i, i + 2), "confidence": c} for i, c in enumerate(confs)]}]}]}


def test_labels_cross_product(docs_from):  # F5 f
    scan = docs_from(label_doc(["animal", "pet"], [0.9, 0.1, 0.5]))
    rows = sorted((r.text_segment, r.start) for r in flatten.labels_flat(scan.good).collect())
    assert rows == [("animal", 0.0), ("animal", 2.0), ("pet", 0.0), ("pet", 2.0)]


def test_labels_without_category(docs_from):  # F5 g
    scan = docs_from(label_doc([], [0.9]))
    assert flatten.labels_flat(scan.good).count() == 0


def test_labels_ranked_text(docs_from):
    scan = docs_from(label_doc(["animal", "pet"], [0.9]))
    r = flatten.labels_ranked(scan.good).first()
    assert r.label == "dog (animal, pet)"


def test_offset_seconds(spark):  # F5 h
    df = spark.createDataFrame(
        [(None,), ({"seconds": None, "nanos": 500000000},), ({"seconds": 3, "nanos": None},)],
        "o STRUCT<seconds: BIGINT, nanos: BIGINT>")
    assert [r[0] for r in df.select(offset_seconds("o")).collect()] == [0.0, 0.5, 3.0]


def test_shot_labels_name_threshold_max(docs_from):
    doc = {"annotation_results": [
        {"input_uri": "/b/v.mp4", "shot_label_annotations": [
            {"entity": {"description": "car"}, "category_entities": [{"description": "vehicle"}],
             "segments": [{"segment": seg(0, 1), "confidence": 0.4},
                          {"segment": seg(1, 2), "confidence": 0.8}]},
            {"entity": {"description": "sky"}, "segments": [{"segment": seg(0, 1), "confidence": 0.0}]}]}]}
    scan = docs_from(doc)
    rows = flatten.shot_labels(scan.good, 0.0).collect()
    assert len(rows) == 1  # FLT-4: the label left without segments drops
    assert rows[0].name == "vehicle car" and rows[0].n_segments == 2
    assert abs(rows[0].highest_confidence - 0.8) < 1e-6


def track_doc():
    frames = [{"time_offset": off(t), "normalized_bounding_box": {"left": 0.1, "top": 0.2, "right": 0.5}}
              for t in (0, 1)]
    return {"annotation_results": [{"input_uri": "/b/v.mp4", "person_detection_annotations": [
        {"confidence": 0.1, "tracks": [{"segment": seg(0, 1), "confidence": 0.9,
                                        "timestamped_objects": [
                                            dict(frames[0], landmarks=[
                                                {"name": "nose", "point": {"x": 0.5, "y": 0.5}},
                                                {"name": "nose", "point": {"x": 0.25, "y": 0.5}}]),
                                            frames[1]]}]}]}]}


def test_person_track_confidence_and_box(docs_from):
    scan = docs_from(track_doc())
    rows = flatten.person_frames(scan.good, 0.5, w=100, h=10).orderBy("frame").collect()
    assert len(rows) == 2 and abs(rows[0].confidence - 0.9) < 1e-6
    r = rows[0]
    assert (r.x, r.y, round(r.width, 9), r.height) == (10.0, 2.0, 40.0, -2.0)  # missing bottom = 0


def test_landmarks_last_wins_and_null(docs_from):
    scan = docs_from(track_doc())
    rows = flatten.landmarks_wide(scan.good, w=100, h=10).orderBy("frame").collect()
    assert rows[0].nose_x == 25.0 and rows[0].left_eye_x is None
    assert rows[1].nose_x is None


def test_face_attributes_percent(docs_from):
    doc = {"annotation_results": [{"input_uri": "/b/v.mp4", "face_detection_annotations": [
        {"thumbnail": "abc", "tracks": [{"segment": seg(0, 1), "confidence": 0.7,
                                         "attributes": [{"name": "smiling", "confidence": 0.567}]}]}]}]}
    r = flatten.face_attributes(docs_from(doc).good).first()
    assert r.smiling == 56 and r.glasses is None and r.thumbnail == "abc"


def test_speech_words_skip_empty(docs_from):
    doc = {"annotation_results": [{"input_uri": "/b/s.mp4", "speech_transcriptions": [
        {"alternatives": [{"transcript": "", "words": [{"word": "x"}]}]},
        {"alternatives": [{"transcript": "hi there", "words": [
            {"word": "hi", "start_time": off(1), "end_time": off(1.5)},
            {"word": "there", "start_time": off(1.5), "end_time": off(2)}]},
            {"transcript": "alt", "words": [{"word": "alt"}]}]}]}]}
    scan = docs_from(doc)
    rows = flatten.speech_words(scan.good).orderBy("word_pos").collect()
    assert [(r.transcription, r.word, r.start, r.end) for r in rows] == [
        (1, "hi", 1.0, 1.5), (1, "there", 1.5, 2.0)]
    span = flatten.speech_spans(scan.good).first()
    assert (span.start, span.end, span.n_words) == (1.0, 2.0, 2)


def test_first_feature_result_and_detected(docs_from):
    doc = {"annotation_results": [
        {"input_uri": "/b/v.mp4", "explicit_annotation": {"frames": []}},
        {"input_uri": "/b/v.mp4", "shot_annotations": [seg(0, 1)],
         "explicit_annotation": {"frames": []}}]}
    scan = docs_from(doc)
    first = {r.feature: r.result_pos for r in
             flatten.first_feature_result(scan.good, ["shot_annotations", "explicit_annotation",
                                                      "text_annotations"]).collect()}
    assert first == {"shot_annotations": 1, "explicit_annotation": 0}
    det = {r.feature: r.n_results for r in
           flatten.detected_features(scan.good, ["shot_annotations", "explicit_annotation"]).collect()}
    assert det == {"shot_annotations": 1, "explicit_annotation": 2}


def test_presence_schema_tells_null_empty_and_filled_apart(spark, tmp_path):
    """One leaf of each feature gives what the whole document gives, also for nulls at every level."""
    filled = {"shot_annotations": [seg(0, 1), None, {"start_time_offset": None}],
              "explicit_annotation": {"frames": [None, {"time_offset": None}]},
              "text_annotations": [{"segments": []}], "face_detection_annotations": [{"thumbnail": None}],
              "speech_transcriptions": [{"alternatives": [{"words": [{"word": "x"}]}]}, {"alternatives": None}]}
    empty = {f: {} if f == "explicit_annotation" else [] for f in S.FEATURE_FIELDS}
    nulls = {f: {"frames": None} if f == "explicit_annotation" else [None] for f in S.FEATURE_FIELDS}
    rows = [("a", [filled, empty]), ("b", [{}, filled, nulls]), ("c", []), ("d", None), ("e", [None, empty, None, nulls]), (None, [{}])]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, f"file STRING, {S.ANNOTATION_DDL}").coalesce(1).write.parquet(path)
    whole = spark.read.parquet(path)
    narrow = spark.read.schema(S.presence_schema(S.FEATURE_FIELDS)).parquet(path)
    for op in (flatten.detected_features, flatten.first_feature_result):
        got, exp = (sorted(map(tuple, op(d, S.FEATURE_FIELDS).collect()), key=repr) for d in (narrow, whole))
        assert got == exp and len(got) == 3 * len(S.FEATURE_FIELDS)
