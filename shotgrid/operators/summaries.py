"""Per-video summaries (AGG-1..5, AGG-8).

A summary that concerns one video and its arrays is computed from the document
row, without a shuffle. ``merge_intervals`` is the general form for rows of any
table: time buckets inside a key, so that one hot key spreads over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotgrid.functions.scalars import likelihood_name, offset_seconds, segment_end, segment_start
from shotgrid.operators.flatten import feature_rows
from shotgrid.plans.numbering import max_before, same
from shotgrid.session import bounded_batches, store

# Buckets of the explicit-content summary, as the viewer lists them.
LIKELIHOOD_BUCKETS = ["VERY_LIKELY", "LIKELY", "POSSIBLE", "UNLIKELY", "VERY_UNLIKELY"]
OTHER_BUCKET = "OTHER"


def _span_text(start, end):
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"))


def _tracks(feature: str, threshold: float | None):
    """The tracks of ``items`` in list order: struct(name, item, track, start, end).

    Objects are tracks themselves; of a logo every track over the threshold counts.
    """
    def one(name, conf, seg, i, j):
        return F.struct(name.alias("name"), i.alias("item"), j.alias("track"), segment_start(seg).alias("start"),
                        segment_end(seg).alias("end"), conf.alias("confidence"))

    if feature == "logo_recognition_annotations":
        every = F.flatten(F.transform("items", lambda o, i: F.transform(
            o["tracks"], lambda t, j: one(o["entity"]["description"], t["confidence"], t["segment"], i, j))))
    else:
        every = F.transform("items", lambda o, i: one(o["entity"]["description"], o["confidence"], o["segment"], i, F.lit(0)))
    return every if threshold is None else F.filter(every, lambda x: x["confidence"] > F.lit(threshold))


def track_segments(docs: DataFrame, threshold: float | None = 0.5,
                   feature: str = "object_annotations") -> DataFrame:
    """AGG-1: per (video, name): track count and ``start-end`` list in track order.

    Row-local: the tracks of a document are sorted by (name, place) once and cut
    where the name changes. Tracks are never merged (the reference's merge
    branch cannot run).
    """
    rows = feature_rows(docs, feature, "first").select("input_uri", F.array_sort(_tracks(feature, threshold)).alias("s"))
    n = F.size("s")
    firsts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | ~F.element_at("s", i)["name"].eqNullSafe(
        F.element_at("s", F.greatest(i - 1, F.lit(1)))["name"]))
    cuts = rows.where(n > 0).select("input_uri", "s", firsts.alias("f"))
    runs = F.transform("f", lambda a, k: F.slice(
        "s", a, F.coalesce(F.try_element_at("f", k + 2), n + 1) - a))
    g = cuts.select("input_uri", F.explode(runs).alias("ts"))
    return g.select("input_uri", F.element_at("ts", 1)["name"].alias("name"),
                    F.size("ts").cast("bigint").alias("n_tracks"),
                    F.array_join(F.transform("ts", lambda x: _span_text(x["start"], x["end"])), ";")
                    .alias("segments"))


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end",
                    order: list[str] | None = None, width: float | None = None) -> DataFrame:
    """AGG-3: merge overlapping intervals per key (merge when start < running max end).

    Rows are dealt by (key, time bucket of ``width``, an hour by default) and merged to
    islands there, which are stored. What earlier buckets carry, their latest end and then their last
    island's start, are running maxima over a tree of buckets (``plans.numbering``), so one
    hot key spreads over its buckets and no window holds more than 4096 rows of it.
    Intervals without a start or an end take no part.
    """
    order_cols = [F.col(start), F.col(end)] + [F.col(c) for c in (order or [])]
    x = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()) \
        .withColumn("_b", F.floor(F.col(start) / F.lit(width or 3600.0)).cast("bigint"))
    local = Window.partitionBy(*keys, "_b").orderBy(*order_cols)
    prev = F.max(end).over(local.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", F.when(prev.isNull() | (F.col(start) >= prev), 1).otherwise(0))
    x = x.withColumn("_n", F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    islands = store(x.groupBy(*keys, "_b", "_n").agg(
        F.min(start).alias("_s"), F.max(end).alias("_e"), F.count(F.lit(1)).alias("_c")), "islands")

    def with_carry(rows, value, name):
        """``rows`` with the maximum of a column over all earlier buckets of the key."""
        per_bucket = rows.groupBy(*keys, "_b").agg(F.max(value).alias("_v"))
        carried = max_before(per_bucket, keys, "_b", "_v", name).withColumnsRenamed(
            {k: f"_j{i}" for i, k in enumerate([*keys, "_b"])})
        names = {k: f"_j{i}" for i, k in enumerate([*keys, "_b"])}
        return rows.join(carried, same(rows, carried, names)).drop(*names.values())

    # an island that starts under the carried end continues the last one before its bucket
    joined = with_carry(islands, F.col("_e"), "_carry").withColumn(
        "_open", F.coalesce(F.col("_s") < F.col("_carry"), F.lit(False)))
    # the islands of a bucket that continue come first in it, so their head lies in an earlier bucket
    own = F.struct("_s", "_n")  # empty intervals may share a start
    headed = with_carry(joined, F.when(~F.col("_open"), own), "_before")
    return headed.withColumn("_head", F.when(F.col("_open"), F.col("_before")).otherwise(own)).groupBy(*keys, "_head").agg(
        F.max("_e").alias("seg_end"), F.sum("_c").alias("n_merged")) \
        .select(*keys, F.col("_head._s").alias("seg_start"), "seg_end", "n_merged")


def _merge_batches(batches):
    """Merge the tracks of each (video, name) of an Arrow batch with one running maximum per name."""
    for rb in batches:
        tracks = rb.column("tracks")
        flat = tracks.flatten()
        size = np.diff(tracks.offsets.to_numpy())
        video = np.repeat(np.arange(len(size)), size)
        names = flat.field("name").dictionary_encode()
        name = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
        start, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        order = np.lexsort((end, start, name, video))
        video, name, start, end = video[order], name[order], start[order], end[order]
        new_key = np.ones(len(order), bool)
        new_key[1:] = (video[1:] != video[:-1]) | (name[1:] != name[:-1])
        run = end.copy()
        bounds = [*np.flatnonzero(new_key).tolist(), len(order)]
        for a, b in zip(bounds, bounds[1:]):
            np.maximum.accumulate(run[a:b], out=run[a:b])
        new = new_key.copy()
        new[1:] |= start[1:] >= run[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(order)) - 1
        uris = rb.column("input_uri")
        yield pa.RecordBatch.from_arrays(
            [uris.take(pa.array(video[first])), flat.field("name").take(pa.array(order[first])),
             pa.array(start[first]), pa.array(run[last]), pa.array((last - first + 1).astype(np.int64))],
            ["input_uri", "name", "seg_start", "seg_end", "n_merged"])


def track_segments_merged(docs: DataFrame, threshold: float | None = 0.5,
                          feature: str = "object_annotations") -> DataFrame:
    """AGG-3: the object (or logo) tracks of each (video, name), overlapping ones merged.

    All tracks of a video lie in its document's row, so nothing is shuffled.
    """
    tracks = F.transform(_tracks(feature, threshold), lambda t: F.struct(
        t["name"].alias("name"), t["start"].alias("start"), t["end"].alias("end")))
    rows = feature_rows(docs, feature, "first").select("input_uri", tracks.alias("tracks")) \
        .where(F.col("tracks").isNotNull())
    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(_merge_batches, "input_uri string, name string, seg_start double, seg_end double, n_merged long")


def merged_tracks(docs: DataFrame, threshold: float | None = 0.5,
                  feature: str = "logo_recognition_annotations") -> DataFrame:
    """AGG-3 by ``merge_intervals``: tracks as rows, so that a video's tracks spread over its time buckets."""
    tracks = feature_rows(docs, feature, "first").select("input_uri", F.explode(_tracks(feature, threshold)).alias("t"))
    return merge_intervals(tracks.select("input_uri", "t.name", "t.start", "t.end"), ["input_uri", "name"])


def person_segments(docs: DataFrame, threshold: float = 0.5, key: str = "person") -> DataFrame:
    """AGG-2: one fixed key per video with its track count and spans; count 0 when empty.

    Row-local: the person annotations of a video are one array of its document.
    """
    feature = "person_detection_annotations" if key == "person" else "face_detection_annotations"
    uri = F.try_element_at(F.col("annotation_results.input_uri"), F.lit(1))
    items = F.try_element_at(F.filter(F.col(f"annotation_results.{feature}"),
                                      lambda x: x.isNotNull()), F.lit(1))
    tracks = F.transform(items, lambda p: F.try_element_at(p["tracks"], F.lit(1)))
    kept = F.filter(tracks, lambda t: t.isNotNull() & (t["confidence"] > F.lit(threshold)))
    spans = F.array_join(F.transform(kept, lambda t: _span_text(
        segment_start(t["segment"]), segment_end(t["segment"]))), ";")
    n = F.when(kept.isNull(), F.lit(0)).otherwise(F.size(kept)).cast("bigint")
    return docs.select(uri.alias("input_uri"), F.lit(key).alias("key"),
                       n.alias("n_tracks"), F.coalesce(spans, F.lit("")).alias("segments"))


def likelihood_buckets(docs: DataFrame) -> DataFrame:
    """AGG-4: explicit frames bucketed by likelihood, all five buckets, real counts.

    An unknown likelihood gets its own bucket (the viewer fails on it).
    """
    rows = feature_rows(docs, "explicit_annotation", "first")
    fr = F.transform("items.frames", lambda f: F.struct(
        offset_seconds(f["time_offset"]).alias("t"),
        likelihood_name(f["pornography_likelihood"]).alias("v")))
    known = F.array(*[F.lit(b) for b in LIKELIHOOD_BUCKETS])

    def bucket(name):
        if name == OTHER_BUCKET:
            return F.filter("fr", lambda f: ~F.array_contains(known, f["v"]))
        return F.filter("fr", lambda f: f["v"] == F.lit(name))

    entries = F.array(*[F.struct(F.lit(b).alias("likelihood"), bucket(b).alias("hits"))
                        for b in LIKELIHOOD_BUCKETS + [OTHER_BUCKET]])
    e = rows.select("input_uri", fr.alias("fr")).select("input_uri", F.explode(entries).alias("e"))
    e = e.where((F.col("e.likelihood") != OTHER_BUCKET) | (F.size("e.hits") > 0))
    return e.select("input_uri", F.col("e.likelihood").alias("likelihood"),
                    F.size("e.hits").cast("bigint").alias("n_frames"),
                    F.array_join(F.transform("e.hits", lambda f: f["t"].cast("string")), ";")
                    .alias("times"))


def frames_by_likelihood(docs: DataFrame, likelihood: str = "LIKELY") -> DataFrame:
    """FLT-6 + AGG-8: number of explicit frames of one likelihood per video."""
    rows = feature_rows(docs, "explicit_annotation", "all")
    hits = F.filter("items.frames",
                    lambda f: likelihood_name(f["pornography_likelihood"]) == F.lit(likelihood))
    return rows.select("input_uri", "result_pos", F.size(hits).cast("bigint").alias("n_frames"))
