"""What is on screen at time t: interval (JN-3) and as-of (JN-4..8) lookups.

Probes are a table ``(input_uri, t)`` (the player's position becomes data).
An as-of lookup is made an interval lookup row-locally: the span of a track is
tiled by its frames (before the first one, between neighbours, from the last one
on), and one range join (``plans.ranges``) finds the tile of every probe. Tiles of
boxes, polygons and landmarks carry only places and times; what the two frames
hold is fetched from the track's row for the hits. A text's tiles, by far the most,
are joined in blocks of neighbours. No ``lead`` window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotgrid.functions.scalars import (LANDMARKS, likelihood_name, offset_seconds,
                                        segment_end, segment_start)
from shotgrid.operators.chunks import shots_enumerated
from shotgrid.operators.flatten import (VIDEO_HEIGHT, VIDEO_WIDTH, _scaled_box, explicit_frames, feature_rows,
                                        object_tracks, person_tracks, shot_label_islands, shot_label_segments,
                                        speech_words)
from shotgrid.plans.ranges import range_join


def frame_pairs(arr: Column) -> Column:
    """Consecutive pairs of an array: struct(j, a = arr[j], b = arr[j + 1]) (0-based j)."""
    n = F.size(arr)
    return F.transform(F.slice(arr, 1, F.greatest(n - 1, F.lit(0))),
                       lambda x, i: F.struct(i.alias("j"), x.alias("a"),
                                             F.element_at(arr, i + 2).alias("b")))


def span_tiles(frames: Column, start: Column, end: Column) -> Column:
    """Tiles of the span [start, end]: struct(ta, tb, closed, j, a, b).

    ``frames`` are structs with ``t``, in time order. ``a`` and ``b`` are the
    frames before and after the tile; both are null before the first frame and
    from the last one on (there the viewer has no box). Only the span's last
    tile holds its end.
    """
    nothing = F.when(F.lit(False), F.try_element_at(frames, F.lit(1)))
    first, last = F.try_element_at(frames, F.lit(1))["t"], F.try_element_at(frames, F.lit(-1))["t"]

    def tile(a, b, j, x, y):
        return F.struct(F.greatest(a, start).alias("ta"), F.least(b, end).alias("tb"), (b > end).alias("closed"),
                        j.cast("int").alias("j"), x.alias("a"), y.alias("b"))

    far = end + F.lit(1.0)
    before = F.array(tile(start, F.coalesce(first, far), F.lit(None), nothing, nothing))
    between = F.transform(frame_pairs(frames), lambda p: tile(p["a"]["t"], p["b"]["t"], p["j"], p["a"], p["b"]))
    after = F.array(tile(F.coalesce(last, far), far, F.lit(None), nothing, nothing))
    tiles = F.concat(before, F.coalesce(between, F.slice(before, 1, 0)), after)
    return F.filter(tiles, lambda x: (x["ta"] < x["tb"]) | (x["closed"] & (x["ta"] == x["tb"])))


def _lerp(a: Column, b: Column, r: Column) -> Column:
    return a + (b - a) * r


def _tile_times(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """The tiles of every track: ``keys``, frame count ``n``, [ta, tb], closed, place ``j`` and times of both frames.

    ``tracks`` has ``keys``, ``fr`` (structs with ``t``), ``span_start`` and ``span_end``.
    What frames hold besides their times stays behind.
    """
    times = F.transform("fr", lambda f: F.struct(f["t"].alias("t")))
    tiles = tracks.select(*keys, F.size("fr").alias("n"),
                          F.explode(span_tiles(times, F.col("span_start"), F.col("span_end"))).alias("p"))
    return tiles.select(*keys, "n", "p.ta", "p.tb", "p.closed", "p.j", F.col("p.a.t").alias("t_a"), F.col("p.b.t").alias("t_b"))


BLOCK = 64  # tiles that go through a range join in one row


def _tile_blocks(tracks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The tiles of every track, ``size`` neighbours a row: ``keys``, frame count ``n``, [ta, tb], place ``base``, times ``x``.

    ``tracks`` as for ``_tile_times``. The times that bound the tiles are the span's start, the
    frames' and one past its end; [ta, tb] holds the part of the span that the row's tiles cover.
    """
    start, end = F.col("span_start"), F.col("span_end")
    times = F.concat(F.array(start), F.coalesce("fr.t", F.array().cast("array<double>")), F.array(end + F.lit(1.0)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_x") - 2) / size).cast("int")), lambda k: F.struct(
        (k * size).alias("base"), F.slice("_x", k * size + 1, size + 1).alias("x")))
    rows = tracks.select(*keys, F.size("fr").alias("n"), "span_start", "span_end", times.alias("_x")) \
        .select(*keys, "n", "span_start", "span_end", F.explode(blocks).alias("b"))
    return rows.select(*keys, "n", F.greatest(start, F.array_min("b.x")).alias("ta"),
                       F.least(end, F.array_max("b.x")).alias("tb"), "b.base", "b.x")


def _tiles_at(probes: DataFrame, tracks: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """The tile of every probe in the tracks it lies in: ``keys``, t, n, j, t_a, t_b.

    The hits of a range join with ``_tile_times``, frames in any order; only blocks of tiles move.
    """
    hit = range_join(probes.select("input_uri", "t"), _tile_blocks(tracks, keys, size), ["input_uri"], "t", "ta", "tb",
                     spread=True)
    x, t, at = F.col("x"), F.col("t"), F.col("base") + F.col("i")
    here = F.filter(F.sequence(F.lit(0), F.size("x") - 2), lambda i: (x[i] <= t) & (t < x[i + 1]))
    found = hit.select(*keys, "t", "n", "base", "x", F.explode(here).alias("i"))
    between = (at >= 1) & (at < F.col("n"))       # neither before the first frame nor from the last one on
    return found.select(*keys, "t", "n", F.when(between, at - 1).alias("j"), F.when(between, x[F.col("i")]).alias("t_a"),
                        F.when(between, x[F.col("i") + 1]).alias("t_b"))


def _neighbours(frames: str, a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """What the frames before and after the tile at ``j`` hold; null outside the frames."""
    return (F.try_element_at(frames, F.col("j") + 1).alias(a), F.try_element_at(frames, F.col("j") + 2).alias(b))


def _in_edge_gap() -> Column:
    """In the first or last gap between frames nothing is interpolated."""
    return (F.col("j") == 0) | (F.col("j") + 1 == F.col("n") - 1)


def _way_between() -> Column:
    return (F.col("t") - F.col("t_a")) / (F.col("t_b") - F.col("t_a"))


# --- interval containment (JN-3, WIN-5) ------------------------------------

def labels_at_time(docs: DataFrame, probes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Shot labels with a segment covering t (both ends inclusive), one row per probe and label.

    A label's segments that meet are merged in its row first, so that a probe hits at most one
    of them and nothing has to be made distinct after the join.
    """
    found = range_join(probes, shot_label_islands(docs, threshold), ["input_uri"], "t", "seg_start", "seg_end")
    return found.select("input_uri", "t", "label_pos", "name")


def shot_at_time(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """The viewer's current shot(s) at t (first result holding shots)."""
    rows = feature_rows(docs, "shot_annotations", "first")
    shots = rows.select("input_uri", F.posexplode("items").alias("pos", "s")).select(
        "input_uri", (F.col("pos") + 1).alias("shot"),
        segment_start(F.col("s")).alias("shot_start"), segment_end(F.col("s")).alias("shot_end"))
    hits = range_join(probes, shots, ["input_uri"], "t", "shot_start", "shot_end")
    return hits.select("input_uri", "t", "shot", "shot_start", "shot_end")


def words_at_time(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """Current spoken word(s) at t."""
    words = speech_words(docs).select("input_uri", "transcription", "word_pos", "word",
                                      F.col("start").alias("w_start"),
                                      F.col("end").alias("w_end"))
    hits = range_join(probes, words, ["input_uri"], "t", "w_start", "w_end")
    return hits.select("input_uri", "t", "transcription", "word_pos", "word")


# --- as-of boxes (JN-4, JN-5) ----------------------------------------------

def _box_tracks(docs: DataFrame, feature: str, w: float, h: float) -> DataFrame:
    """(input_uri, track, part, confidence, span_start, span_end, fr: ARRAY<STRUCT<t, box>>).

    Objects are tracks themselves; persons and faces show the first track of an
    annotation; a logo shows each of its tracks (``part`` is its place).
    """
    rows = feature_rows(docs, feature, "first")
    it = rows.select("input_uri", F.posexplode("items").alias("track", "o"))
    if feature == "object_annotations":
        it = it.select("input_uri", "track", F.lit(0).alias("part"), F.col("o").alias("x"))
        frames = F.col("x.frames")
    else:
        tracks = F.col("o.tracks") if feature == "logo_recognition_annotations" else F.slice("o.tracks", 1, 1)
        it = it.select("input_uri", "track", F.posexplode(tracks).alias("part", "x"))
        frames = F.col("x.timestamped_objects")
    fr = F.transform(frames, lambda f: F.struct(
        offset_seconds(f["time_offset"]).alias("t"),
        _scaled_box(f["normalized_bounding_box"], w, h).alias("box")))
    seg = F.col("x.segment")
    return it.select("input_uri", "track", "part", F.col("x.confidence").alias("confidence"),
                     segment_start(seg).alias("span_start"), segment_end(seg).alias("span_end"),
                     F.coalesce(fr, F.slice(fr, 1, 0)).alias("fr"))


def box_at_time(docs: DataFrame, probes: DataFrame, interpolate: bool = True,
                feature: str = "object_annotations", w: float = VIDEO_WIDTH,
                h: float = VIDEO_HEIGHT, threshold: float | None = 0.5) -> DataFrame:
    """Box of every track (confidence over ``threshold``) whose span covers t.

    Real box (JN-4): the frame before the first later frame; null before the
    first frame and from the last one on. Interpolated (JN-5): linear between
    the neighbours, except in the first and last gap where the earlier box is
    returned. A logo shows its earliest listed track over the threshold that
    covers t.
    """
    tracks = _box_tracks(docs, feature, w, h)
    if threshold is not None:
        tracks = tracks.where(F.col("confidence") > F.lit(threshold))
    # the range join carries places and times; boxes are fetched for the hits
    keys = ["input_uri", "track", "part"]
    hit = range_join(probes, _tile_times(tracks, keys), ["input_uri"], "t", "ta", "tb", closed="closed")
    if feature == "logo_recognition_annotations":
        at = ["part", "j", "n", "t_a", "t_b"]
        hit = hit.groupBy("input_uri", "t", "track").agg(F.min(F.struct(*at)).alias("s")) \
            .select("input_uri", "t", "track", *[f"s.{c}" for c in at])
    found = hit.join(tracks.select(*keys, F.col("fr.box").alias("boxes")), keys).select(
        *keys, "t", "j", "n", "t_a", "t_b", *_neighbours("boxes"))
    edge, r = _in_edge_gap(), _way_between()
    out = []
    for c in ("x", "y", "width", "height"):
        a, b = F.col("a")[c], F.col("b")[c]
        out.append((F.when(edge, a).otherwise(_lerp(a, b, r)) if interpolate else a).alias(c))
    return found.select("input_uri", "t", "track", *out)


# --- polygons (JN-6) ------------------------------------------------------

def polygon_at_time(docs: DataFrame, probes: DataFrame, w: float = VIDEO_WIDTH,
                    h: float = VIDEO_HEIGHT, threshold: float = 0.5, docs_times: DataFrame | None = None) -> DataFrame:
    """Interpolated 4-point polygon per text; a text uses its first segment
    (among those over ``threshold``) covering t.

    ``docs_times`` may be the same documents read without text and vertices
    (``schema.TEXT_TIMES_DDL``); the lookup needs no more, the hits' polygons come from ``docs``.
    """
    def segments(d, *of_text):
        tx = feature_rows(d, "text_annotations", "first").select("input_uri", F.posexplode("items").alias("text_pos", "x"))
        return tx.select("input_uri", "text_pos", *[F.col(f"x.{c}").alias(c) for c in of_text],
                         F.posexplode("x.segments").alias("segment_pos", "s")).where(F.col("s.confidence") > F.lit(threshold))

    # the range join carries places and times; polygons are fetched for the hits
    keys = ["input_uri", "text_pos", "segment_pos"]
    times = F.transform("s.frames", lambda f: F.struct(offset_seconds(f["time_offset"]).alias("t")))
    spans = segments(docs_times if docs_times is not None else docs).select(
        *keys, times.alias("fr"), segment_start(F.col("s.segment")).alias("span_start"),
        segment_end(F.col("s.segment")).alias("span_end"))
    first = _tiles_at(probes, spans, keys).groupBy("input_uri", "t", "text_pos").agg(
        F.min(F.struct("segment_pos", "j", "n", "t_a", "t_b")).alias("x")).select("input_uri", "t", "text_pos", "x.*")
    frames = segments(docs, "text").select(*keys, "text", F.col("s.frames.rotated_bounding_box.vertices").alias("polygons"))
    found = first.join(frames, keys).select(
        "input_uri", "t", "text_pos", "text", "j", "n", "t_a", "t_b", *_neighbours("polygons"))
    edge, r = _in_edge_gap(), _way_between()
    cols = []
    for i in range(4):
        a, b = F.try_element_at("a", F.lit(i + 1)), F.try_element_at("b", F.lit(i + 1))
        for c, size in (("x", w), ("y", h)):
            cols.append(F.when(edge, a[c] * size).otherwise(_lerp(a[c] * size, b[c] * size, r)).alias(f"{c}{i}"))
    return found.select("input_uri", "t", "text_pos", "text", *cols)


# --- landmarks (JN-7) -----------------------------------------------------

def landmarks_at_time(docs: DataFrame, probes: DataFrame, w: float = VIDEO_WIDTH,
                      h: float = VIDEO_HEIGHT, threshold: float | None = 0.5) -> DataFrame:
    """Interpolated landmarks per person track (first track's confidence over
    ``threshold``) whose span covers t.

    Only names present in both neighbouring frames are interpolated; in the
    first and last gap the earlier frame's landmarks are returned.
    One row per (probe, person, landmark name).
    """
    rows = feature_rows(docs, "person_detection_annotations", "first")
    it = rows.select("input_uri", F.posexplode("items").alias("person", "p"))
    first = F.try_element_at(F.col("p.tracks"), F.lit(1))
    known = F.array(*[F.lit(n) for n in LANDMARKS])
    fr = F.transform(first["timestamped_objects"], lambda f: F.struct(
        offset_seconds(f["time_offset"]).alias("t"),
        F.filter(f["landmarks"], lambda l: F.array_contains(known, l["name"])).alias("lm")))
    tracks = it.select("input_uri", "person", segment_start(first["segment"]).alias("span_start"),
                       segment_end(first["segment"]).alias("span_end"), fr.alias("fr"),
                       first["confidence"].alias("confidence"))
    if threshold is not None:
        tracks = tracks.where(F.col("confidence") > F.lit(threshold))
    # the range join carries places and times; landmarks are fetched for the hits
    keys = ["input_uri", "person"]
    tiles = _tile_times(tracks, keys).where(F.col("j").isNotNull())
    hit = range_join(probes, tiles, ["input_uri"], "t", "ta", "tb", closed="closed") \
        .join(tracks.select(*keys, F.col("fr.lm").alias("marks")), keys)
    hit = hit.select("input_uri", "t", "person", *_neighbours("marks", "la", "lb"),
                     _in_edge_gap().alias("edge"), _way_between().alias("r"))
    names = F.array_distinct(F.transform("la", lambda l: l["name"]))
    lm = hit.select("*", F.explode(names).alias("name"))

    def point(arr: str) -> Column:  # last point of that name in the frame
        return F.try_element_at(F.filter(arr, lambda l: l["name"] == F.col("name")), F.lit(-1))["point"]

    pa, pb = point("la"), point("lb")
    keep = F.col("edge") | pb.isNotNull()
    x = F.when(F.col("edge"), pa["x"] * w).otherwise(_lerp(pa["x"] * w, pb["x"] * w, F.col("r")))
    y = F.when(F.col("edge"), pa["y"] * h).otherwise(_lerp(pa["y"] * h, pb["y"] * h, F.col("r")))
    return lm.where(keep).select("input_uri", "t", "person", F.col("name").alias("landmark"),
                                 x.alias("x"), y.alias("y"))


# --- likelihood (JN-8) ----------------------------------------------------

def likelihood_at_time(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """Explicit-content likelihood at t >= 0: the frame before the first later one,
    at least the first; an empty string from the last frame on and where a video
    has no frames."""
    rows = feature_rows(docs, "explicit_annotation", "first")
    fr = F.transform("items.frames", lambda f: F.struct(
        offset_seconds(f["time_offset"]).alias("t"),
        likelihood_name(f["pornography_likelihood"]).alias("v")))
    per_video = rows.select("input_uri", fr.alias("fr"))
    first = F.try_element_at(F.col("fr"), F.lit(1))
    pairs = F.transform(frame_pairs(F.col("fr")), lambda p: F.struct(
        p["a"]["t"].alias("ta"), p["b"]["t"].alias("tb"), p["a"]["v"].alias("v")))
    before = F.array(F.struct(F.least(F.lit(0.0), first["t"]).alias("ta"), first["t"].alias("tb"), first["v"].alias("v")))
    tiles = per_video.select("input_uri", F.explode(F.concat(before, pairs)).alias("x")).select("input_uri", "x.*") \
        .where(F.col("ta") < F.col("tb"))
    hit = range_join(probes, tiles, ["input_uri"], "t", "ta", "tb", how="left", end_inclusive=False)
    return hit.select("input_uri", "t", F.coalesce(F.col("v"), F.lit("")).alias("likelihood"))


# --- timeline position (PRJ-4) --------------------------------------------

def timeline_pct(docs: DataFrame, lengths: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Start and width of each shot-label segment as percent of the video length."""
    segs = shot_label_segments(docs, threshold)
    j = segs.join(lengths, "input_uri")
    return j.select("input_uri", "label_pos", "segment_pos",
                    (F.col("start") / F.col("length") * 100).alias("left_pct"),
                    ((F.col("end") - F.col("start")) / F.col("length") * 100).alias("width_pct"))


def spans_pct(spans: DataFrame, lengths: DataFrame, *ids: str) -> DataFrame:
    """PRJ-4 of any spans (input_uri, start, end): the ``ids`` columns, left and width in percent.

    Only ids and two times go through the join. Without a length the video has
    no row; a length of 0 or null gives null positions.
    """
    j = spans.select("input_uri", *ids, "start", "end").join(lengths.select("input_uri", "length"), "input_uri")
    part = lambda c: F.try_divide(c, F.col("length")) * 100
    return j.select("input_uri", *ids, part(F.col("start")).alias("left_pct"),
                    part(F.col("end") - F.col("start")).alias("width_pct"))


def object_timeline_pct(docs: DataFrame, lengths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """PRJ-4 of object tracks over threshold: (input_uri, track, name, left_pct, width_pct)."""
    return spans_pct(object_tracks(docs, threshold), lengths, "track", "name")


def person_timeline_pct(docs: DataFrame, lengths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """PRJ-4 of the first track of each person, over threshold: (input_uri, person, left_pct, width_pct)."""
    return spans_pct(person_tracks(docs, threshold), lengths, "person")


def explicit_timeline_pct(docs: DataFrame, lengths: DataFrame) -> DataFrame:
    """PRJ-4 of explicit frames, as points (their drawn width is fixed): (input_uri, frame_pos, explicit_content, left_pct)."""
    frames = explicit_frames(docs, "first").withColumn("end", F.col("start"))
    return spans_pct(frames, lengths, "frame_pos", "explicit_content").drop("width_pct")


def misaligned(docs: DataFrame, lengths: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """FLT-11: video length vs whole end seconds of the first result; missing -> False."""
    d = docs.select("file",
                    F.try_element_at(F.col("annotation_results.input_uri"), F.lit(1)).alias("input_uri"),
                    F.try_element_at(F.col("annotation_results.segment"), F.lit(1))
                    ["end_time_offset"]["seconds"].alias("end_seconds"))
    j = d.join(lengths, "input_uri", "left")
    flag = F.coalesce(F.abs(F.col("length") - F.col("end_seconds")) > F.lit(tolerance),
                      F.lit(False))
    return j.select("file", "input_uri", "length", "end_seconds", flag.alias("misaligned"))


__all__ = ["labels_at_time", "shot_at_time", "words_at_time", "box_at_time",
           "polygon_at_time", "landmarks_at_time", "likelihood_at_time", "timeline_pct",
           "spans_pct", "object_timeline_pct", "person_timeline_pct", "explicit_timeline_pct",
           "misaligned", "frame_pairs", "shots_enumerated"]
