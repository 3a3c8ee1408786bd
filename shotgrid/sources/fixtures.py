"""Fold the driver's flat tables into the nested annotation shape.

The library's operators consume annotation documents (one row per file with
``annotation_results``). The test tables are flat, so this module folds them
into that shape with Spark (``groupBy`` + ``sort_array(collect_list(struct))``)
and the oracle recomputes the same answers from the flat rows.

Mapping (events -> one document per user = video):

* a document holds all events of one user (video = user), at every scale, as
  the annotation service writes one file per video;
* ``off`` = microseconds since 2024-01-01 00:00:00, ``seconds = off div 1e6``,
  ``nanos = (off % 1e6) * 1000``; events ordered by ``(off, event_id)``.
* ``conf = least(floor(value / 10) / 10, 1.0)``;
  ``off2 = off + k * 1800 s`` where ``k`` is ``props.k``.
* result 0: shots starting before day 15, explicit frames (all events),
  segment labels, text; result 1: shots from day 15 on, shot labels,
  object, logo, person and face tracks. Shots are ``[off_i, off_{i+1})``.
* one parent per (user, event_type) for labels/text/tracks; a logo's events are
  two tracks, the earlier and the later half.
* videos of users with ``user_id % 7 = 3`` carry no explicit frames, those with
  ``user_id % 7 = 5`` no logos, persons or faces.

Conversations -> one document per conversation holding speech transcriptions
(one per turn; word i starts at ``turn * 1000 + i * 0.5`` s and lasts 0.5 s).
Documents -> chunk tags and model outputs for the catalogue.

``event_shot_parts`` cuts the same shots into parts by time.

A real deployment reads annotation JSON instead (``sources.annotations``),
one file per video as the annotation service writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotgrid import schema as S
from shotgrid.sources import parts as P

# Fixed values of the fixture folding.
EPOCH = "2024-01-01 00:00:00"
HALF_MICROS = 15 * 86400 * 1_000_000
LANG_BY_USER_MOD4 = ["fr-FR", "es-ES", "de-DE", "en-US"]
LIKELIHOOD_BY_EVENT = {"view": "VERY_UNLIKELY", "signup": "UNLIKELY", "click": "POSSIBLE",
                       "purchase": "LIKELY", "error": "VERY_LIKELY"}
NO_EXPLICIT, NO_TRACKS = 3, 5  # user_id % 7 of videos without these features


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offset(micros: Column) -> Column:
    m = micros.cast("bigint")
    rem = m % F.lit(1_000_000)
    return F.struct(((m - rem) / F.lit(1_000_000)).cast("bigint").alias("seconds"),
                    (rem * F.lit(1000)).cast("bigint").alias("nanos"))


def segment(a: Column, b: Column) -> Column:
    return F.struct(offset(a).alias("start_time_offset"), offset(b).alias("end_time_offset"))


def user_uri(user_id: Column) -> Column:
    lang = F.element_at(F.array(*[F.lit(x) for x in LANG_BY_USER_MOD4]),
                        (user_id % 4 + 1).cast("int"))
    return F.concat(F.lit("/bucket/"), lang, F.lit("/"), user_id.cast("string"), F.lit(".mp4"))


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    off = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', ts)")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (ev.select(
        "event_id", "user_id", "event_type", "value",
        off.alias("off"), k.alias("k"),
        F.least(F.floor(F.col("value") / 10) / 10, F.lit(1.0)).alias("conf"),
        user_uri(F.col("user_id")).alias("input_uri"))
        .withColumn("off2", F.col("off") + F.col("k") * F.lit(1_800_000_000)))


def _box(e: Column) -> Column:
    left = e["value"] / 1000
    top = e["k"] / 1000
    return F.struct(left.alias("left"), top.alias("top"), (left + 0.1).alias("right"),
                    (top + 0.1).alias("bottom"))


def _pt(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _text_frames(e: Column) -> Column:
    n = e["k"] % 20
    left = e["value"] / 1000

    def frame(f):
        top = f / 100
        verts = F.array(_pt(left, top), _pt(left + 0.1, top), _pt(left + 0.1, top + 0.1),
                        _pt(left, top + 0.1))
        return F.struct(offset(e["off"] + f * 1_000_000).alias("time_offset"),
                        F.struct(verts.alias("vertices")).alias("rotated_bounding_box"))

    seq = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0).cast("bigint")))
    return F.when(n > 0, F.transform(seq, frame)).otherwise(F.array().cast(
        "array<struct<time_offset:struct<seconds:bigint,nanos:bigint>,"
        "rotated_bounding_box:struct<vertices:array<struct<x:double,y:double>>>>>"))


def _landmarks(e: Column) -> Column:
    left = e["value"] / 1000
    top = e["k"] / 1000
    nose = F.struct(F.lit("nose").alias("name"), _pt(left + 0.05, top + 0.05).alias("point"))
    eye = F.struct(F.lit("left_eye").alias("name"), _pt(left + 0.02, top + 0.02).alias("point"))
    return F.when(e["k"] % 2 == 0, F.array(nose, eye)).otherwise(F.array(nose))


def _parent(p: Column) -> Column:
    """One parent record per (user, event_type) for every feature, from the type's events in order."""
    evs, et = p["evs"], p["event_type"]
    first, last = F.element_at(evs, 1), F.element_at(evs, -1)
    entity = F.struct(et.alias("entity_id"), et.alias("description"))
    cat = F.concat(F.lit("cat_"), et)
    categories = F.array(F.struct(cat.alias("entity_id"), cat.alias("description")),
                         F.struct(F.lit("all").alias("entity_id"), F.lit("all").alias("description")))
    span = segment(first["off"], last["off"])
    label_segments = F.transform(evs, lambda e: F.struct(
        segment(e["off"], e["off2"]).alias("segment"), e["conf"].alias("confidence")))
    text_segments = F.transform(evs, lambda e: F.struct(
        segment(e["off"], e["off2"]).alias("segment"), e["conf"].alias("confidence"),
        _text_frames(e).alias("frames")))
    frames = F.transform(evs, lambda e: F.struct(
        offset(e["off"]).alias("time_offset"), _box(e).alias("normalized_bounding_box")))
    person_frames = F.transform(evs, lambda e: F.struct(
        offset(e["off"]).alias("time_offset"), _box(e).alias("normalized_bounding_box"),
        _landmarks(e).alias("landmarks")))
    attributes = F.array(
        F.struct(F.lit("smiling").alias("name"), first["conf"].alias("confidence")),
        F.struct(F.lit("glasses").alias("name"), (first["k"] / 100).alias("confidence")))
    half = F.floor(F.size(evs) / 2).cast("int")

    def logo_track(part):
        return F.struct(segment(F.element_at(part, 1)["off"], F.element_at(part, -1)["off"]).alias("segment"),
                        F.element_at(part, 1)["conf"].alias("confidence"),
                        F.transform(part, lambda e: F.struct(
                            offset(e["off"]).alias("time_offset"), _box(e).alias("normalized_bounding_box")))
                        .alias("timestamped_objects"))

    halves = F.filter(F.array(F.slice(evs, F.lit(1), half), F.slice(evs, half + 1, F.size(evs))), lambda x: F.size(x) > 0)
    return F.struct(
        F.struct(et.alias("text"), text_segments.alias("segments")).alias("text"),
        F.struct(entity.alias("entity"), categories.alias("category_entities"),
                 label_segments.alias("segments")).alias("label"),
        F.struct(entity.alias("entity"), first["conf"].alias("confidence"),
                 span.alias("segment"), frames.alias("frames")).alias("object"),
        F.struct(entity.alias("entity"), F.transform(halves, logo_track).alias("tracks")).alias("logo"),
        F.struct(last["conf"].alias("confidence"), F.array(F.struct(
            span.alias("segment"), first["conf"].alias("confidence"),
            person_frames.alias("timestamped_objects"))).alias("tracks")).alias("person"),
        F.struct(F.concat(et, F.lit("-"), p["user"].cast("string")).alias("thumbnail"),
                 F.array(F.struct(span.alias("segment"), first["conf"].alias("confidence"),
                                  attributes.alias("attributes"),
                                  frames.alias("timestamped_objects"))).alias("tracks")).alias("face"))


def _nonempty(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def _result(**fields: Column) -> Column:
    cols = []
    for name, ddl in S.RESULT_FIELDS:
        c = fields.get(name)
        cols.append((c if c is not None else F.lit(None).cast(ddl)).alias(name))
    return F.struct(*cols).cast(S.RESULT)


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events -> one annotation document per user with two results.

    Flat events are shuffled once, by user; what is nested is made row by row from a user's
    ordered events, so that no record of a feature is shuffled, sorted or spilled.
    """
    ev = flat_events(spark, sf_dir).where(F.col("user_id").isNotNull()).repartition("user_id")
    lik = F.create_map(*[x for k, v in LIKELIHOOD_BY_EVENT.items() for x in (F.lit(k), F.lit(v))])
    by_type = ev.groupBy("user_id", "input_uri", "event_type").agg(F.sort_array(F.collect_list(
        F.struct("off", "event_id", "event_type", "off2", "conf", "k", "value"))).alias("evs"))
    per_user = by_type.groupBy("user_id", "input_uri").agg(F.sort_array(F.collect_list(
        F.struct("event_type", F.col("user_id").alias("user"), "evs"))).alias("types"))
    per_user = per_user.select("user_id", "input_uri", "types", F.sort_array(F.flatten("types.evs")).alias("evs")) \
        .withColumn("last_off", F.array_max("evs.off"))
    evs = F.col("evs")
    pairs = F.transform(F.slice(evs, 1, F.size(evs) - 1),
                        lambda e, i: F.struct(e["off"].alias("a"),
                                              F.element_at(evs, i + 2)["off"].alias("b")))
    to_shot = lambda s: segment(s["a"], s["b"])
    per_user = per_user.select(
        "user_id", "input_uri", F.transform("types", _parent).alias("ps"),
        segment(F.lit(0), F.col("last_off")).alias("video_segment"),
        _nonempty(F.transform(F.filter(pairs, lambda s: s["a"] < HALF_MICROS), to_shot)).alias("shots0"),
        _nonempty(F.transform(F.filter(pairs, lambda s: s["a"] >= HALF_MICROS), to_shot)).alias("shots1"),
        F.transform(evs, lambda e: F.struct(
            offset(e["off"]).alias("time_offset"),
            lik[e["event_type"]].alias("pornography_likelihood"))).alias("explicit_frames"))
    ps = F.col("ps")

    def field(name):
        return F.transform(ps, lambda p: p[name])

    feats = {f: field(f) for f in ("text", "label", "object", "logo", "person", "face")}
    uri, seg = F.col("input_uri"), F.col("video_segment")
    kind = F.col("user_id") % 7
    tracked = {f: F.when(kind != NO_TRACKS, feats[f]) for f in ("logo", "person", "face")}
    r0 = _result(input_uri=uri, segment=seg, shot_annotations=F.col("shots0"),
                 explicit_annotation=F.when(kind != NO_EXPLICIT, F.struct(F.col("explicit_frames").alias("frames"))),
                 segment_label_annotations=feats["label"], text_annotations=feats["text"])
    r1 = _result(input_uri=uri, segment=seg, shot_annotations=F.col("shots1"),
                 shot_label_annotations=feats["label"], object_annotations=feats["object"],
                 logo_recognition_annotations=tracked["logo"],
                 person_detection_annotations=tracked["person"],
                 face_detection_annotations=tracked["face"])
    return per_user.select(F.concat(F.lit("annotations/"), F.col("user_id").cast("string"), F.lit(".json")).alias("file"),
                           F.array(r0, r1).alias("annotation_results"))


def event_shot_parts(spark: SparkSession, sf_dir: str, size: int | None = P.PART) -> DataFrame:
    """The shots of ``event_documents`` as parts, without a row or an aggregate that holds a whole user.

    Shot i starts at event i, so a part of events gives its shots and the next part's first event
    ends the last one. A user's shots before day 15 are result 0, the others result 1.
    """
    ev = flat_events(spark, sf_dir).select("user_id", "input_uri", "off", "event_id")
    cut = P.cut_points(ev, ["user_id", "input_uri"], ["off", "event_id"], "off", size)
    pairs = F.transform("values", lambda a, i: F.struct(
        a.alias("a"), F.coalesce(F.try_element_at("values", i + 2), F.col("next")).alias("b")))
    parts = cut.select("user_id", "input_uri", "part", F.filter(pairs, lambda s: s["b"].isNotNull()).alias("pairs"))
    early, late = F.filter("pairs", lambda s: s["a"] < HALF_MICROS), F.filter("pairs", lambda s: s["a"] >= HALF_MICROS)
    parts = parts.select("user_id", "input_uri", "part", early.alias("r0"), late.alias("r1"))
    users = parts.groupBy("user_id").agg(F.sum(F.size("r0")).alias("n0"), F.sum(F.size("r1")).alias("n1"),
                                         F.count("*").alias("n_parts"))          # one small row a user
    base = F.col("part") * F.lit(size or 0)
    shots = [F.struct(F.col("input_uri"), b.cast("bigint").alias("base"), F.when(F.col(f"n{k}") > 0, F.transform(
        f"r{k}", lambda s: segment(s["a"], s["b"]))).alias("shot_annotations"))
        for k, b in ((0, base), (1, F.greatest(base - F.col("n0"), F.lit(0))))]
    return parts.join(users, "user_id").select(
        F.concat(F.lit("annotations/"), F.col("user_id").cast("string"), F.lit(".json")).alias("file"), "part", "n_parts",
        F.array(*shots).cast(f"ARRAY<{P.SHOT_RESULT}>").alias("annotation_results"))


WORD_SPLIT = r"[ \t\n\r]+"


def conversation_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def speech_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations -> one document per conversation with speech transcriptions."""
    cv = read_table(spark, sf_dir, "conversations")
    base = F.col("turn") * F.lit(1_000_000_000)
    words = F.transform(conversation_words(F.col("text")), lambda w, i: F.struct(
        w.alias("word"),
        offset(base + i * 500_000).alias("start_time"),
        offset(base + i * 500_000 + 500_000).alias("end_time")))
    transcription = F.struct(F.array(F.struct(
        F.col("text").alias("transcript"), words.alias("words"))).alias("alternatives"))
    per_conv = cv.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", transcription.alias("t")))).alias("turns"))
    cid = F.col("conv_id").cast("string")
    r = _result(input_uri=F.concat(F.lit("/bucket/speech/"), cid, F.lit(".mp4")),
                speech_transcriptions=F.transform("turns", lambda x: x["t"]))
    return per_conv.select(F.concat(F.lit("speech/"), cid, F.lit(".json")).alias("file"),
                           F.array(r).alias("annotation_results"))


def as_annotations(spark: SparkSession, sf_dir: str, schema: T.StructType | None = None) -> DataFrame:
    return stored_documents(spark, sf_dir, "events", schema).unionByName(
        stored_documents(spark, sf_dir, "speech", schema))


_STORED: dict[tuple, str] = {}


# A reader unpacks up to 4,096 rows of a row group at once, whole documents here: small row groups bound its memory.
GROUP_ROWS, GROUP_BYTES = 256, 16 << 20


def write_documents(docs: DataFrame, path: str) -> None:
    """Write documents as Parquet in row groups of at most ``GROUP_ROWS`` documents and about ``GROUP_BYTES``."""
    docs.write.mode("overwrite").option("parquet.block.row.count.limit", GROUP_ROWS) \
        .option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1).parquet(path)


def stored_documents(spark: SparkSession, sf_dir: str, kind: str = "events",
                     schema: T.StructType | str | None = None) -> DataFrame:
    """The folded documents (or, with ``shots``, their shots in parts) as a stored annotation table (nested Parquet).

    Folded once per session and state of the input (its files, with their sizes
    and times), written under the shared checkpoint folder and read back:
    operators then scan a stored table with nested-column pruning, as they would
    over annotations kept in a lake. ``schema`` narrows what is read of every document
    (``schema.presence_schema``, ``schema.TEXT_TIMES_DDL``). The table goes when the application ends.
    """
    from shotgrid.session import file_state, remove_at_exit, session_id, shared_dir
    table = "conversations" if kind == "speech" else "events"
    key = (session_id(spark), sf_dir, kind, file_state(spark, f"{sf_dir}/{table}.parquet"))
    path = _STORED.get(key)
    if path is None:
        build = {"events": event_documents, "speech": speech_documents, "shots": event_shot_parts}[kind]
        path = shared_dir(spark, "annotations", kind)
        write_documents(build(spark, sf_dir), path)
        remove_at_exit(spark, path)
        _STORED[key] = path
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


BROKEN, HALF_BROKEN = 4, 6  # user_id % 11 of videos whose JSON is cut off, or holds a wrong type


def annotation_lines(docs: DataFrame) -> DataFrame:
    """One JSON text per document (shots only); of broken ones it is cut off, of half-broken ones text stands for a number."""
    # fields taken from the whole array, so that only they are read from storage
    shots = F.col("annotation_results.shot_annotations")
    slim = F.transform("annotation_results.input_uri", lambda uri, i: F.struct(
        uri.alias("input_uri"), F.element_at(shots, i + 1).alias("shot_annotations")))
    text = F.to_json(F.struct(slim.alias("annotation_results")))
    kind = F.regexp_extract("file", r"(\d+)\.json$", 1).cast("bigint") % 11
    value = (F.when(kind == BROKEN, text.substr(F.lit(1), F.length(text) - 2))
             .when(kind == HALF_BROKEN, F.concat(
                 F.lit('{"annotation_results":[{"shot_annotations":[{"start_time_offset":{"seconds":"x5"}}]},'),
                 F.regexp_replace(text, r"^\{\"annotation_results\":\[", "")))
             .otherwise(text))
    return docs.select(value.alias("value"))


def annotation_json(spark: SparkSession, sf_dir: str) -> str:
    """A folder of annotation JSON lines, some of them broken or half broken."""
    from shotgrid.session import remove_at_exit, shared_dir
    path = shared_dir(spark, "annotation_json")
    annotation_lines(stored_documents(spark, sf_dir, "events")).write.text(path)
    remove_at_exit(spark, path)
    return path


def video_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-side video length per uri: whole seconds of the last event + user_id % 5."""
    ev = flat_events(spark, sf_dir)
    return ev.groupBy("user_id", "input_uri").agg(F.max("off").alias("last_off")).select(
        "input_uri",
        (F.floor(F.col("last_off") / 1_000_000) + F.col("user_id") % 5).cast("double").alias("length"))


def probes(spark: SparkSession, sf_dir: str, step: float = 43200.0, n: int = 60) -> DataFrame:
    """Play positions ``(input_uri, t)``: t = i * step for every video."""
    ev = flat_events(spark, sf_dir).select("input_uri").distinct()
    return ev.select("input_uri", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")) \
        .select("input_uri", (F.col("i") * F.lit(step)).alias("t"))


def speech_probes(spark: SparkSession, sf_dir: str, step: float = 250.0, n: int = 32) -> DataFrame:
    cv = read_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    uri = F.concat(F.lit("/bucket/speech/"), F.col("conv_id").cast("string"), F.lit(".mp4"))
    return cv.select(uri.alias("input_uri"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")) \
        .select("input_uri", (F.col("i") * F.lit(step)).alias("t"))


def chunk_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags on chunk objects (F3); every tenth document carries none."""
    d = read_table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % 10 != 0).select(
        chunk_uri(F.col("doc_id"), F.col("source")).alias("uri"),
        F.concat(F.lit("gs://in/"), F.col("source"), F.lit(".mp4")).alias("video_source"),
        F.col("source").alias("video_blobname"),
        F.col("doc_id").cast("string").alias("index"),
        (F.col("doc_id") * 2.5).cast("string").alias("time_start"),
        (F.col("doc_id") * 2.5 + 2.5).cast("string").alias("time_stop"))


def chunk_uri(doc_id: Column, source: Column) -> Column:
    return F.concat(F.lit("gs://out/CSA/"), source, F.lit("/chunks - "), doc_id.cast("string"),
                    F.lit(".mp4"))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model descriptions per chunk uri; some are failures (``ERROR``...)."""
    d = read_table(spark, sf_dir, "documents")
    desc = (F.when(F.col("doc_id") % 7 == 0, F.lit("ERROR"))
            .when(F.col("doc_id") % 7 == 1, F.concat(F.lit("ERROR: "), F.col("lang")))
            .otherwise(F.col("text")))
    return d.select(chunk_uri(F.col("doc_id"), F.col("source")).alias("uri"),
                    desc.alias("description"))
