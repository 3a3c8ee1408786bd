"""Nested annotation -> flat tables (explode family).

Every operator here is row-local: ``posexplode`` / ``transform`` / ``filter``
over the arrays of one document row. Nothing shuffles, nothing leaves the JVM,
and Catalyst prunes the nested fields that are not used (Parquet input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotgrid.functions.scalars import (FACE_ATTRIBUTES, LANDMARKS, category_suffix, js_number,
                                        likelihood_name, offset_seconds, percent_int,
                                        segment_end, segment_start)

VIDEO_WIDTH, VIDEO_HEIGHT = 800, 500


def narrow(confidence: Column) -> Column:
    """A stored confidence as the 32-bit value the warehouse tables compare (the viewer's is 64-bit)."""
    return confidence.cast("float").cast("double")


def results(docs: DataFrame) -> DataFrame:
    """One row per annotation result: file, result_pos, input_uri, r (whole result)."""
    return docs.select("file", F.posexplode("annotation_results").alias("result_pos", "r")) \
        .select("file", "result_pos", F.col("r.input_uri").alias("input_uri"), "r")


def result_field(name: str) -> Column:
    """``annotation_results.<name>``: one value per result.

    Field extraction over the result array (not a lambda) is what lets
    Catalyst prune the Parquet read down to that feature's subtree.
    """
    return F.col(f"annotation_results.{name}")


def feature_rows(docs: DataFrame, feature: str, mode: str = "first") -> DataFrame:
    """PRJ-2: the results a feature is read from.

    ``mode="first"``: only the first result holding the feature (viewer rule);
    ``"all"``: every result holding it (pipeline rule). Output: file,
    (result_pos,) input_uri, items = the feature's value (array or struct).
    Only ``input_uri`` and the feature are read from storage.
    """
    uris, feats = result_field("input_uri"), result_field(feature)
    if mode == "first":
        d = docs.select("file", uris.alias("_u"), feats.alias("_f"))
        d = d.withColumn("_i", F.array_position(
            F.transform("_f", lambda x: x.isNotNull()), F.lit(True)).cast("int"))
        found = F.col("_i") > 0  # guard inside each value: filters may be reordered
        return d.where(found).select(
            "file", F.when(found, F.element_at("_u", F.col("_i"))).alias("input_uri"),
            F.when(found, F.element_at("_f", F.col("_i"))).alias("items"))
    d = docs.select("file", uris.alias("_u"), feats.alias("_f")) \
        .select("file", "_u", F.posexplode("_f").alias("result_pos", "items"))
    return d.where(F.col("items").isNotNull()).select(
        "file", "result_pos", F.element_at("_u", F.col("result_pos") + 1).alias("input_uri"),
        "items")


def first_feature_result(docs: DataFrame, features: list[str]) -> DataFrame:
    """PRJ-2 as a table: (file, feature, result_pos) of the first result holding it."""
    entries = F.array(*[F.struct(
        F.lit(f).alias("feature"),
        (F.array_position(F.transform(result_field(f), _present), True) - 1).alias("result_pos"))
        for f in features])
    return docs.select("file", F.explode(entries).alias("e")) \
        .where(F.col("e.result_pos") >= 0) \
        .select("file", F.col("e.feature").alias("feature"),
                F.col("e.result_pos").cast("bigint").alias("result_pos"))


def _present(x: Column) -> Column:
    return x.isNotNull()


def detected_features(docs: DataFrame, features: list[str]) -> DataFrame:
    """NST-15: features present in a file, with how many results carry each."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"),
                                 F.size(F.filter(result_field(f), _present)).alias("n"))
                        for f in features])
    return docs.select("file", F.explode(entries).alias("e")).where(F.col("e.n") > 0) \
        .select("file", F.col("e.feature").alias("feature"),
                F.col("e.n").cast("bigint").alias("n_results"))


# --- explicit content -------------------------------------------------------

def explicit_frames(docs: DataFrame, mode: str = "all") -> DataFrame:
    """NST-1: (input_uri, frame_pos, start, explicit_content)."""
    rows = feature_rows(docs, "explicit_annotation", mode)
    f = rows.select("input_uri", F.posexplode("items.frames").alias("frame_pos", "f"))
    return f.select("input_uri", "frame_pos",
                    offset_seconds(F.col("f.time_offset")).alias("start"),
                    likelihood_name(F.col("f.pornography_likelihood")).alias("explicit_content"))


def explicit_flat(docs: DataFrame) -> DataFrame:
    return explicit_frames(docs).select(F.col("input_uri").alias("uri"), "start", "explicit_content")


# --- OCR --------------------------------------------------------------------

def ocr_flat(docs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """NST-2 + FLT-2: one row per text from its first segment only, conf > threshold.

    A text without segments yields no row (the reference loses the file's
    whole table instead).
    """
    rows = feature_rows(docs, "text_annotations", "all")
    t = rows.select("input_uri", F.explode("items").alias("t"))
    seg = F.try_element_at(F.col("t.segments"), F.lit(1))
    return t.select("input_uri", F.col("t.text").alias("text_segment"), seg.alias("s")) \
        .where(narrow(F.col("s.confidence")) > F.lit(threshold)) \
        .select(F.col("input_uri").alias("uri"),
                segment_start(F.col("s.segment")).alias("start"),
                segment_end(F.col("s.segment")).alias("stop"), "text_segment")


def ocr_segments(docs: DataFrame, mode: str = "all") -> DataFrame:
    """NST-3: every (text, segment): confidence, start, end, duration, frame count."""
    rows = feature_rows(docs, "text_annotations", mode)
    t = rows.select("input_uri", F.posexplode("items").alias("text_pos", "t"))
    s = t.select("input_uri", "text_pos", F.col("t.text").alias("text"),
                 F.posexplode("t.segments").alias("segment_pos", "s"))
    start, end = segment_start(F.col("s.segment")), segment_end(F.col("s.segment"))
    return s.select("input_uri", "text_pos", "segment_pos", "text",
                    F.col("s.confidence").alias("confidence"), start.alias("start"),
                    end.alias("end"), (end - start).alias("duration"),
                    F.coalesce(F.size("s.frames"), F.lit(0)).cast("bigint").alias("n_frames"))


def ocr_min_frames(docs: DataFrame, min_frames: int = 15) -> DataFrame:
    """FLT-5 + SRT-2: segments with at least ``min_frames`` frames.

    ``rank`` is the place in its file by end time (list order breaks ties); the
    order is made inside the document's row.
    """
    rows = feature_rows(docs, "text_annotations", "all")
    every = F.flatten(F.transform("items", lambda t, i: F.transform(t["segments"], lambda x, j: F.struct(
        segment_end(x["segment"]).alias("end"), i.alias("text_pos"), j.alias("segment_pos"), t["text"].alias("text"),
        x["confidence"].alias("confidence"), segment_start(x["segment"]).alias("start"),
        F.coalesce(F.size(x["frames"]), F.lit(0)).cast("bigint").alias("n_frames")))))
    kept = F.array_sort(F.filter(every, lambda x: x["n_frames"] >= min_frames))
    s = rows.select("input_uri", F.posexplode(kept).alias("rank", "s")).select("input_uri", "rank", "s.*")
    return s.select("input_uri", (F.col("rank") + 1).alias("rank"), "text_pos", "segment_pos", "text", "confidence",
                    "start", "end", (F.col("end") - F.col("start")).alias("duration"), "n_frames")


# --- labels -----------------------------------------------------------------

def labels_flat(docs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """NST-4: one row per category x segment over threshold; value = category text."""
    rows = feature_rows(docs, "segment_label_annotations", "all")
    lab = rows.select("input_uri", F.explode("items").alias("l"))
    cs = lab.select("input_uri", F.explode("l.category_entities").alias("c"), "l")
    s = cs.select("input_uri", F.col("c.description").alias("text_segment"),
                  F.explode("l.segments").alias("s")) \
        .where(narrow(F.col("s.confidence")) > F.lit(threshold))
    return s.select(F.col("input_uri").alias("uri"),
                    segment_start(F.col("s.segment")).alias("start"),
                    segment_end(F.col("s.segment")).alias("stop"), "text_segment")


def labels_ranked(docs: DataFrame) -> DataFrame:
    """NST-19 + SCL-6 + SRT-3: ``entity (cat, ...)`` per segment.

    ``rank`` is the label's place in its file by first segment confidence
    (descending, list order breaks ties), made inside the document's row.
    """
    rows = feature_rows(docs, "segment_label_annotations", "all")
    ranked = F.array_sort(F.transform("items", lambda l, i: F.struct(
        (-F.try_element_at(l["segments"], F.lit(1))["confidence"]).alias("order"), i.alias("label_pos"), l.alias("l"))),
        lambda x, y: F.when(x["order"] < y["order"], -1).when(x["order"] > y["order"], 1)
        .when(x["order"].isNull() & y["order"].isNotNull(), 1).when(x["order"].isNotNull() & y["order"].isNull(), -1)
        .otherwise(x["label_pos"] - y["label_pos"]))
    lab = rows.select("input_uri", F.posexplode(ranked).alias("rank", "x"))
    lab = lab.select("input_uri", (F.col("rank") + 1).alias("rank"), "x.label_pos",
                     F.concat(F.col("x.l.entity.description"),
                              category_suffix(F.col("x.l.category_entities"))).alias("label"),
                     F.try_element_at(F.col("x.l.segments"), F.lit(1))["confidence"]
                     .alias("first_confidence"),
                     F.posexplode("x.l.segments").alias("segment_pos", "s"))
    return lab.select("input_uri", "rank", "label_pos", "segment_pos", "label", "first_confidence",
                      F.col("s.confidence").alias("confidence"),
                      segment_start(F.col("s.segment")).alias("start"),
                      segment_end(F.col("s.segment")).alias("end"))


def _label_name() -> Column:
    """A label's first category, if any, and its own description."""
    first_cat = F.try_element_at(F.col("l.category_entities"), F.lit(1))["description"]
    return F.concat(F.coalesce(F.concat(first_cat, F.lit(" ")), F.lit("")), F.col("l.entity.description"))


def shot_label_segments(docs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """NST-5 rows: (input_uri, label_pos, name, segment_pos, confidence, start, end)."""
    rows = feature_rows(docs, "shot_label_annotations", "first")
    lab = rows.select("input_uri", F.posexplode("items").alias("label_pos", "l"))
    s = lab.select("input_uri", "label_pos", _label_name().alias("name"),
                   F.posexplode("l.segments").alias("segment_pos", "s")) \
        .where(F.col("s.confidence") > F.lit(threshold))
    return s.select("input_uri", "label_pos", "name", "segment_pos",
                    F.col("s.confidence").alias("confidence"),
                    segment_start(F.col("s.segment")).alias("start"),
                    segment_end(F.col("s.segment")).alias("end"))


def shot_label_islands(docs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(input_uri, label_pos, name, seg_start, seg_end): each label's segments, those that meet merged into one.

    Row-local: a label's segments are sorted by start and folded where any two neighbours
    meet; where none do, they stay as they are. Segments without a start or an end, or that
    end before they start, cover nothing.
    """
    rows = feature_rows(docs, "shot_label_annotations", "first")
    lab = rows.select("input_uri", F.posexplode("items").alias("label_pos", "l"))
    spans = F.transform(F.filter("l.segments", lambda s: s["confidence"] > F.lit(threshold)), lambda s: F.struct(
        segment_start(s["segment"]).alias("seg_start"), segment_end(s["segment"]).alias("seg_end")))
    spans = F.array_sort(F.filter(spans, lambda s: s["seg_start"] <= s["seg_end"]))
    lab = lab.select("input_uri", "label_pos", _label_name().alias("name"), spans.alias("spans"))

    def fold(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["seg_start"].alias("seg_start"), F.greatest(last["seg_end"], s["seg_end"]).alias("seg_end"))
        return F.when(s["seg_start"] <= last["seg_end"],
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    n = F.size("spans")
    rest = F.slice("spans", 2, F.greatest(n - 1, F.lit(0)))
    meets = F.exists(F.zip_with(F.slice("spans", 1, F.greatest(n - 1, F.lit(0))), rest,
                                lambda x, y: y["seg_start"] <= x["seg_end"]), lambda m: m)
    islands = F.when(meets, F.aggregate(rest, F.slice("spans", 1, 1), fold)).otherwise(F.col("spans"))
    return lab.select("input_uri", "label_pos", "name", F.inline(islands))


def shot_labels(docs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """NST-5 + FLT-3/4 + AGG-5 on the label arrays themselves (no shuffle)."""
    rows = feature_rows(docs, "shot_label_annotations", "first")
    lab = rows.select("input_uri", F.posexplode("items").alias("label_pos", "l"))
    kept = F.filter("l.segments", lambda s: s["confidence"] > F.lit(threshold))
    out = lab.select("input_uri", "label_pos", _label_name().alias("name"), kept.alias("kept"))
    return out.where(F.size("kept") > 0).select(
        "input_uri", "label_pos", "name",
        F.size("kept").cast("bigint").alias("n_segments"),
        F.array_max(F.transform("kept", lambda s: s["confidence"])).alias("highest_confidence"))


# --- tracks -----------------------------------------------------------------

def _scaled_box(box: Column, w: float, h: float) -> Column:
    left = F.coalesce(box["left"], F.lit(0.0))
    top = F.coalesce(box["top"], F.lit(0.0))
    right = F.coalesce(box["right"], F.lit(0.0))
    bottom = F.coalesce(box["bottom"], F.lit(0.0))
    return F.struct((left * w).alias("x"), (top * h).alias("y"),
                    ((right - left) * w).alias("width"), ((bottom - top) * h).alias("height"))


def object_tracks(docs: DataFrame, threshold: float | None = 0.5) -> DataFrame:
    """NST-8 + FLT-3: (input_uri, track, name, confidence, start, end, n_frames)."""
    rows = feature_rows(docs, "object_annotations", "first")
    o = rows.select("input_uri", F.posexplode("items").alias("track", "o"))
    if threshold is not None:
        o = o.where(F.col("o.confidence") > F.lit(threshold))
    return o.select("input_uri", "track", F.col("o.entity.description").alias("name"),
                    F.col("o.confidence").alias("confidence"),
                    segment_start(F.col("o.segment")).alias("start"),
                    segment_end(F.col("o.segment")).alias("end"),
                    F.coalesce(F.size("o.frames"), F.lit(0)).cast("bigint").alias("n_frames"))


def object_frames(docs: DataFrame, w: float = VIDEO_WIDTH, h: float = VIDEO_HEIGHT) -> DataFrame:
    """NST-8 + PRJ-5: (input_uri, track, frame, t, x, y, width, height)."""
    rows = feature_rows(docs, "object_annotations", "first")
    o = rows.select("input_uri", F.posexplode("items").alias("track", "o"))
    f = o.select("input_uri", "track", F.posexplode("o.frames").alias("frame", "f"))
    b = _scaled_box(F.col("f.normalized_bounding_box"), w, h)
    return f.select("input_uri", "track", "frame", offset_seconds(F.col("f.time_offset")).alias("t"),
                    b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("width"),
                    b["height"].alias("height"))


def logo_tracks(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """NST-12: logo tracks over threshold under entity name and id."""
    rows = feature_rows(docs, "logo_recognition_annotations", "first")
    lg = rows.select("input_uri", F.posexplode("items").alias("logo", "l"))
    tr = lg.select("input_uri", "logo", F.col("l.entity.entity_id").alias("entity_id"),
                   F.col("l.entity.description").alias("name"),
                   F.posexplode("l.tracks").alias("track", "t")) \
        .where(F.col("t.confidence") > F.lit(threshold))
    return tr.select("input_uri", "logo", "entity_id", "name", "track",
                     F.col("t.confidence").alias("confidence"),
                     segment_start(F.col("t.segment")).alias("start"),
                     segment_end(F.col("t.segment")).alias("end"))


def person_tracks(docs: DataFrame, threshold: float | None = 0.5) -> DataFrame:
    """NST-9: first track of each person annotation; threshold on the track's confidence."""
    rows = feature_rows(docs, "person_detection_annotations", "first")
    p = rows.select("input_uri", F.posexplode("items").alias("person", "p"))
    t = p.select("input_uri", "person", F.try_element_at(F.col("p.tracks"), F.lit(1)).alias("t")) \
        .where(F.col("t").isNotNull())
    if threshold is not None:
        t = t.where(F.col("t.confidence") > F.lit(threshold))
    return t.select("input_uri", "person", F.col("t.confidence").alias("confidence"),
                    segment_start(F.col("t.segment")).alias("start"),
                    segment_end(F.col("t.segment")).alias("end"),
                    F.col("t.timestamped_objects").alias("frames"))


def person_frames(docs: DataFrame, threshold: float | None = 0.5, w: float = VIDEO_WIDTH,
                  h: float = VIDEO_HEIGHT) -> DataFrame:
    """NST-9 + PRJ-5: (input_uri, person, confidence, frame, t, x, y, width, height)."""
    t = person_tracks(docs, threshold)
    f = t.select("input_uri", "person", "confidence", F.posexplode("frames").alias("frame", "f"))
    b = _scaled_box(F.col("f.normalized_bounding_box"), w, h)
    return f.select("input_uri", "person", "confidence", "frame",
                    offset_seconds(F.col("f.time_offset")).alias("t"),
                    b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("width"),
                    b["height"].alias("height"))


def landmark_point(landmarks: Column, name: str, w: float, h: float) -> Column:
    """NST-10: the named point (last one wins), scaled; null when absent."""
    hit = F.try_element_at(F.filter(landmarks, lambda l: l["name"] == F.lit(name)), F.lit(-1))
    return F.struct((hit["point"]["x"] * w).alias("x"), (hit["point"]["y"] * h).alias("y"))


def landmarks_wide(docs: DataFrame, w: float = VIDEO_WIDTH, h: float = VIDEO_HEIGHT) -> DataFrame:
    """NST-10: one row per person frame, two columns per landmark name."""
    t = person_tracks(docs, None)
    f = t.select("input_uri", "person", F.posexplode("frames").alias("frame", "f"))
    cols = []
    for name in LANDMARKS:
        p = landmark_point(F.col("f.landmarks"), name, w, h)
        cols += [p["x"].alias(f"{name}_x"), p["y"].alias(f"{name}_y")]
    return f.select("input_uri", "person", "frame",
                    offset_seconds(F.col("f.time_offset")).alias("t"), *cols)


def face_attributes(docs: DataFrame, threshold: float | None = 0.5) -> DataFrame:
    """NST-11 + SCL-14 + FLT-3: first track per face (kept when its confidence is
    over ``threshold``); attributes as whole percents."""
    rows = feature_rows(docs, "face_detection_annotations", "first")
    fc = rows.select("input_uri", F.posexplode("items").alias("face", "fa"))
    t = fc.select("input_uri", "face", F.col("fa.thumbnail").alias("thumbnail"),
                  F.try_element_at(F.col("fa.tracks"), F.lit(1)).alias("t")) \
        .where(F.col("t").isNotNull())
    if threshold is not None:
        t = t.where(F.col("t.confidence") > F.lit(threshold))
    attrs = []
    for name in FACE_ATTRIBUTES:
        hit = F.try_element_at(F.filter("t.attributes", _named(name)), F.lit(-1))
        attrs.append(percent_int(hit["confidence"].cast("double")).alias(name))
    return t.select("input_uri", "face", "thumbnail",
                    F.col("t.confidence").alias("confidence"),
                    segment_start(F.col("t.segment")).alias("start"),
                    segment_end(F.col("t.segment")).alias("end"), *attrs)


def _named(name: str):
    return lambda a: a["name"] == F.lit(name)


# --- speech -----------------------------------------------------------------

def speech_words(docs: DataFrame) -> DataFrame:
    """NST-13 + FLT-9: first alternative of each transcription -> words."""
    rows = feature_rows(docs, "speech_transcriptions", "first")
    tr = rows.select("input_uri", F.posexplode("items").alias("transcription", "x"))
    alt = tr.select("input_uri", "transcription",
                    F.try_element_at(F.col("x.alternatives"), F.lit(1)).alias("a")) \
        .where(F.col("a.transcript") != F.lit(""))
    w = alt.select("input_uri", "transcription", F.posexplode("a.words").alias("word_pos", "w"))
    return w.select("input_uri", "transcription", "word_pos", F.col("w.word").alias("word"),
                    offset_seconds(F.col("w.start_time")).alias("start"),
                    offset_seconds(F.col("w.end_time")).alias("end"))


def speech_spans(docs: DataFrame) -> DataFrame:
    """AGG-7: start of the first word, end of the last word, in list order."""
    rows = feature_rows(docs, "speech_transcriptions", "first")
    tr = rows.select("input_uri", F.posexplode("items").alias("transcription", "x"))
    alt = tr.select("input_uri", "transcription",
                    F.try_element_at(F.col("x.alternatives"), F.lit(1)).alias("a")) \
        .where((F.col("a.transcript") != F.lit("")) & (F.size("a.words") > 0))
    first = F.try_element_at(F.col("a.words"), F.lit(1))
    last = F.try_element_at(F.col("a.words"), F.lit(-1))
    return alt.select("input_uri", "transcription",
                      F.size("a.words").cast("bigint").alias("n_words"),
                      offset_seconds(first["start_time"]).alias("start"),
                      offset_seconds(last["end_time"]).alias("end"))


# --- text detections (viewer) ----------------------------------------------

def text_frames(docs: DataFrame, w: float = VIDEO_WIDTH, h: float = VIDEO_HEIGHT) -> DataFrame:
    """NST-14 + PRJ-6: text segments -> frames with the polygon scaled.

    Output: input_uri, text_pos, text, segment_pos, frame, t, vertices
    (ARRAY<STRUCT<x, y>>; a missing vertex stays null).
    """
    rows = feature_rows(docs, "text_annotations", "first")
    t = rows.select("input_uri", F.posexplode("items").alias("text_pos", "x"))
    s = t.select("input_uri", "text_pos", F.col("x.text").alias("text"),
                 F.posexplode("x.segments").alias("segment_pos", "s"))
    f = s.select("input_uri", "text_pos", "text", "segment_pos",
                 segment_start(F.col("s.segment")).alias("seg_start"),
                 segment_end(F.col("s.segment")).alias("seg_end"),
                 F.posexplode("s.frames").alias("frame", "f"))
    verts = F.transform(F.col("f.rotated_bounding_box.vertices"),
                        lambda v: F.struct((v["x"] * w).alias("x"), (v["y"] * h).alias("y")))
    return f.select("input_uri", "text_pos", "text", "segment_pos", "seg_start", "seg_end",
                    "frame", offset_seconds(F.col("f.time_offset")).alias("t"),
                    verts.alias("vertices"))


def text_tracks(docs: DataFrame, threshold: float = 0.5, w: float = VIDEO_WIDTH,
                h: float = VIDEO_HEIGHT) -> DataFrame:
    """NST-14 + AGG-7 + SRT-4 + SCL-13 + FLT-3: one item per text detection.

    Segments over ``threshold`` are kept (a text with none drops); the span runs
    from the first kept segment's start to the last kept segment's end, in list
    order. The id is start, end and the scaled points of the first kept
    segment's first frame, written one after another (no points without a
    frame). ``rank`` is the place in its file by start time.
    """
    rows = feature_rows(docs, "text_annotations", "first")

    def item(x, i):
        kept = F.filter(x["segments"], lambda s: s["confidence"] > F.lit(threshold))
        first, last = F.try_element_at(kept, F.lit(1)), F.try_element_at(kept, F.lit(-1))
        points = F.try_element_at(first["frames"], F.lit(1))["rotated_bounding_box"]["vertices"]
        poly = F.array_join(F.transform(points, lambda v: F.concat(
            js_number(v["x"] * w), js_number(v["y"] * h))), "")
        start, end = segment_start(first["segment"]), segment_end(last["segment"])
        return F.struct(start.alias("start"), i.alias("text_pos"), x["text"].alias("text"), end.alias("end"),
                        F.concat(js_number(start), js_number(end), F.coalesce(poly, F.lit(""))).alias("item_id"),
                        F.size(kept).alias("n"))

    kept = F.array_sort(F.filter(F.transform("items", item), lambda x: x["n"] > 0))
    t = rows.select("input_uri", F.posexplode(kept).alias("rank", "x"))
    return t.select("input_uri", (F.col("rank") + 1).alias("rank"), "x.text_pos", "x.text", "x.start", "x.end", "x.item_id")


def text_digest(docs: DataFrame) -> DataFrame:
    """AGG-9: distinct texts of a result, sorted and joined by ``, `` (row-local)."""
    rows = feature_rows(docs, "text_annotations", "all")
    texts = F.array_sort(F.array_distinct(F.transform("items", lambda x: x["text"])))
    return rows.select("input_uri", F.array_join(texts, ", ").alias("digest"))
