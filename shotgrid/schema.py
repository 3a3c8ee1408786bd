"""Schemas of the annotation document, arrival events, tags and sink tables."""

from __future__ import annotations

from pyspark.sql import types as T

OFFSET = "STRUCT<seconds: BIGINT, nanos: BIGINT>"
SEGMENT = f"STRUCT<start_time_offset: {OFFSET}, end_time_offset: {OFFSET}>"
ENTITY = "STRUCT<entity_id: STRING, description: STRING>"
BOX = "STRUCT<left: DOUBLE, top: DOUBLE, right: DOUBLE, bottom: DOUBLE>"

SHOT = SEGMENT
EXPLICIT = f"STRUCT<frames: ARRAY<STRUCT<time_offset: {OFFSET}, pornography_likelihood: STRING>>>"
LABEL = (f"STRUCT<entity: {ENTITY}, category_entities: ARRAY<{ENTITY}>, "
         f"segments: ARRAY<STRUCT<segment: {SEGMENT}, confidence: DOUBLE>>>")
TEXT = (f"STRUCT<text: STRING, segments: ARRAY<STRUCT<segment: {SEGMENT}, confidence: DOUBLE, "
        f"frames: ARRAY<STRUCT<time_offset: {OFFSET}, "
        f"rotated_bounding_box: STRUCT<vertices: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>>>>>")
OBJECT = (f"STRUCT<entity: {ENTITY}, confidence: DOUBLE, segment: {SEGMENT}, "
          f"frames: ARRAY<STRUCT<time_offset: {OFFSET}, normalized_bounding_box: {BOX}>>>")
TIMED_BOX = f"STRUCT<time_offset: {OFFSET}, normalized_bounding_box: {BOX}>"
LOGO = (f"STRUCT<entity: {ENTITY}, tracks: ARRAY<STRUCT<segment: {SEGMENT}, confidence: DOUBLE, "
        f"timestamped_objects: ARRAY<{TIMED_BOX}>>>>")
PERSON = (f"STRUCT<confidence: DOUBLE, tracks: ARRAY<STRUCT<segment: {SEGMENT}, confidence: DOUBLE, "
          f"timestamped_objects: ARRAY<STRUCT<time_offset: {OFFSET}, normalized_bounding_box: {BOX}, "
          f"landmarks: ARRAY<STRUCT<name: STRING, point: STRUCT<x: DOUBLE, y: DOUBLE>>>>>>>>")
FACE = (f"STRUCT<thumbnail: STRING, tracks: ARRAY<STRUCT<segment: {SEGMENT}, confidence: DOUBLE, "
        f"attributes: ARRAY<STRUCT<name: STRING, confidence: DOUBLE>>, "
        f"timestamped_objects: ARRAY<{TIMED_BOX}>>>>")
SPEECH = (f"STRUCT<alternatives: ARRAY<STRUCT<transcript: STRING, words: ARRAY<STRUCT<"
          f"word: STRING, start_time: {OFFSET}, end_time: {OFFSET}>>>>>")

# Field order of one annotation result; fixtures build structs in this order.
RESULT_FIELDS = [
    ("input_uri", "STRING"),
    ("segment", SEGMENT),
    ("shot_annotations", f"ARRAY<{SHOT}>"),
    ("explicit_annotation", EXPLICIT),
    ("segment_label_annotations", f"ARRAY<{LABEL}>"),
    ("shot_label_annotations", f"ARRAY<{LABEL}>"),
    ("text_annotations", f"ARRAY<{TEXT}>"),
    ("object_annotations", f"ARRAY<{OBJECT}>"),
    ("logo_recognition_annotations", f"ARRAY<{LOGO}>"),
    ("person_detection_annotations", f"ARRAY<{PERSON}>"),
    ("face_detection_annotations", f"ARRAY<{FACE}>"),
    ("speech_transcriptions", f"ARRAY<{SPEECH}>"),
]
RESULT = "STRUCT<" + ", ".join(f"{n}: {t}" for n, t in RESULT_FIELDS) + ">"
ANNOTATION_DDL = f"annotation_results ARRAY<{RESULT}>"

# Features a result may carry, in the order the viewer lists them.
FEATURE_FIELDS = [n for n, _ in RESULT_FIELDS[2:]]

# Stored documents without what texts and frames hold besides their times.
TEXT_TIMES = (f"STRUCT<segments: ARRAY<STRUCT<segment: {SEGMENT}, confidence: DOUBLE, "
              f"frames: ARRAY<STRUCT<time_offset: {OFFSET}>>>>>")
TEXT_TIMES_DDL = f"file STRING, annotation_results ARRAY<STRUCT<input_uri: STRING, text_annotations: ARRAY<{TEXT_TIMES}>>>"


def annotation_schema(corrupt_column: str | None = "_corrupt") -> T.StructType:
    schema = T.StructType.fromDDL(ANNOTATION_DDL)
    if corrupt_column:
        schema = schema.add(corrupt_column, T.StringType())
    return schema


def reduced_schema(features: list[str], corrupt_column: str | None = "_corrupt") -> T.StructType:
    """Read schema holding only the listed features (plus uri and segment).

    JSON has no column pruning of its own; giving the reader a narrower schema
    is what keeps the parser from materialising unused subtrees.
    """
    keep = [(n, t) for n, t in RESULT_FIELDS if n in ("input_uri", "segment") or n in features]
    result = "STRUCT<" + ", ".join(f"{n}: {t}" for n, t in keep) + ">"
    schema = T.StructType.fromDDL(f"annotation_results ARRAY<{result}>")
    if corrupt_column:
        schema = schema.add(corrupt_column, T.StringType())
    return schema


def presence_schema(features: list[str]) -> T.StructType:
    """Read schema of stored documents that tells which features a result holds, by one leaf of each.

    Any leaf of a Parquet column tells null from empty and from filled, so the one under the
    fewest lists is read; vertices, words and boxes stay in storage.
    """
    result = T.StructType([f for f in T.StructType.fromDDL(f"r {RESULT}")["r"].dataType if f.name in features])
    kept = T.StructType([T.StructField(f.name, _one_leaf(f.dataType)) for f in result])
    return T.StructType([T.StructField("file", T.StringType()), T.StructField("annotation_results", T.ArrayType(kept))])


def _one_leaf(t: T.DataType) -> T.DataType:
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_one_leaf(t.elementType))
    if isinstance(t, T.StructType):
        f = min(t, key=lambda f: _leaf_cost(f.dataType))
        return T.StructType([T.StructField(f.name, _one_leaf(f.dataType))])
    return t


def _leaf_cost(t: T.DataType) -> tuple[int, bool]:
    """Lists above the cheapest leaf, and whether it is a text."""
    if isinstance(t, T.ArrayType):
        lists, text = _leaf_cost(t.elementType)
        return lists + 1, text
    if isinstance(t, T.StructType):
        return min(_leaf_cost(f.dataType) for f in t)
    return 0, isinstance(t, T.StringType)


ARRIVAL = (
    "id STRING, type STRING, bucket STRING, name STRING, metageneration STRING, "
    "timeCreated TIMESTAMP, updated TIMESTAMP, contentType STRING")

TAGS = (
    "uri STRING, video_source STRING, video_blobname STRING, index STRING, "
    "time_start STRING, time_stop STRING")

RESULTS_TYPED = (
    "index INT, time_start DOUBLE, time_stop DOUBLE, video_blobname STRING, "
    "video_source STRING, description STRING, update_time STRING, uri STRING")

EMBEDDINGS_TYPED = (
    "video_source STRING, description STRING, embeddings ARRAY<DOUBLE>, index INT, "
    "start DOUBLE, stop DOUBLE")
