"""Column -> Column helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Likelihood names in enum order (0 = unspecified), as the annotation API
# numbers them.
LIKELIHOODS = ["LIKELIHOOD_UNSPECIFIED", "VERY_UNLIKELY", "UNLIKELY", "POSSIBLE",
               "LIKELY", "VERY_LIKELY"]
# Feature names the request path knows; anything else is UNKNOWN.
FEATURES = ["OBJECT_TRACKING", "LABEL_DETECTION", "SHOT_CHANGE_DETECTION",
            "SPEECH_TRANSCRIPTION", "LOGO_RECOGNITION", "EXPLICIT_CONTENT_DETECTION",
            "TEXT_DETECTION", "FACE_DETECTION", "PERSON_DETECTION"]
# Feature enum numbers of the public annotation API.
FEATURE_NUMBERS = {"LABEL_DETECTION": 1, "SHOT_CHANGE_DETECTION": 2,
                   "EXPLICIT_CONTENT_DETECTION": 3, "FACE_DETECTION": 4,
                   "SPEECH_TRANSCRIPTION": 6, "TEXT_DETECTION": 7, "OBJECT_TRACKING": 9,
                   "LOGO_RECOGNITION": 12, "PERSON_DETECTION": 14}
# Language codes looked for in a uri, in list order; a later match wins.
LANGUAGE_CODES = ["en-US", "fr-FR", "es-ES", "de-DE", "it-IT", "pt-PT", "pt-BR",
                  "zh-CN", "ja-JP", "ko-KR", "ar-XA", "ru-RU", "hi-IN"]
DEFAULT_LANGUAGE = "en-US"
# Person landmark names, in display order.
LANDMARKS = ["nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder",
             "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist",
             "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle"]
# Face attributes shown as percentages.
FACE_ATTRIBUTES = ["glasses", "eyes_visible", "headwear", "looking_at_camera",
                   "mouth_open", "smiling"]
# Chunk objects are written under this tag prefix.
TAG_TO_ANALYZE = "CSA"
# Context text longer than LIMIT characters is cut to CUT characters.
CONTEXT_LIMIT, CONTEXT_CUT = 1024, 1000
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def offset_seconds(offset) -> Column:
    """SCL-1: ``{seconds, nanos}`` -> DOUBLE seconds; a missing part is 0."""
    o = _c(offset)
    return (F.coalesce(o.getField("seconds"), F.lit(0).cast("bigint"))
            + F.coalesce(o.getField("nanos"), F.lit(0).cast("bigint")) / F.lit(1e9))


def segment_start(segment) -> Column:
    return offset_seconds(_c(segment).getField("start_time_offset"))


def segment_end(segment) -> Column:
    return offset_seconds(_c(segment).getField("end_time_offset"))


def likelihood_name(value) -> Column:
    """SCL-11 (likelihood): names stay; enum numbers given as text map to names."""
    v = _c(value)
    names = F.array(*[F.lit(n) for n in LIKELIHOODS])
    idx = F.when(v.rlike("^[0-5]$"), v.cast("int"))
    return F.when(idx.isNotNull(), F.element_at(names, idx + 1)).otherwise(v)


def feature_name(value) -> Column:
    """SCL-11 (feature): enum name or number -> name, anything else UNKNOWN."""
    v = _c(value).cast("string")
    by_number = F.create_map(*[x for name, num in FEATURE_NUMBERS.items()
                               for x in (F.lit(str(num)), F.lit(name))])
    known = F.array(*[F.lit(n) for n in FEATURES])
    return (F.when(F.array_contains(known, v), v)
            .when(by_number.getItem(v).isNotNull(), by_number.getItem(v))
            .otherwise(F.lit("UNKNOWN")))


def split_gs_uri(uri, strict: bool = False) -> Column:
    """SCL-2: ``gs://bucket/path`` -> struct(bucket, blob); null (or error) otherwise."""
    u = _c(uri)
    pattern = r"^gs://([^/]+)/(.+)$"
    ok = u.rlike(pattern)
    bucket = F.regexp_extract(u, pattern, 1)
    blob = F.regexp_extract(u, pattern, 2)
    if strict:
        bucket = F.when(ok, bucket).otherwise(
            F.raise_error(F.concat(F.lit("invalid gs uri: "), u)))
        return F.struct(bucket.alias("bucket"), F.when(ok, blob).alias("blob"))
    return F.struct(F.when(ok, bucket).alias("bucket"), F.when(ok, blob).alias("blob"))


def local_name(path) -> Column:
    """SCL-3: blob path -> flat local file name (``/`` -> ``_``)."""
    return F.translate(_c(path), "/", "_")


def replace_extension(path, new_extension: str) -> Column:
    """SCL-4: drop the last extension of the last path part, then append.

    Leading dots of a name are not an extension (``.bashrc`` keeps its name).
    """
    base = F.regexp_replace(_c(path), r"^((?:.*/)?\.*[^/.][^/]*)\.[^./]*$", "$1")
    return F.concat(base, F.lit(new_extension))


def base_name(path) -> Column:
    """SCL-5: text before the first dot of the path, then its last ``/`` part."""
    return F.substring_index(F.substring_index(_c(path), ".", 1), "/", -1)


def audio_name(path) -> Column:
    """SCL-5: the path with its last character swapped to ``3`` (mp4 -> mp3)."""
    p = _c(path)
    return F.concat(p.substr(F.lit(1), F.length(p) - 1), F.lit("3"))


def language_code(uri) -> Column:
    """SCL-7: the last listed code found in the uri wins; default en-US."""
    u = _c(uri)
    out = F.lit(DEFAULT_LANGUAGE)
    for code in LANGUAGE_CODES:
        out = F.when(u.contains(code), F.lit(code)).otherwise(out)
    return out


def clean_json(text) -> Column:
    """SCL-8: strip ``json``/``JSON``/code fences, single -> double quotes."""
    t = _c(text)
    for token in ("json", "JSON", "```"):
        t = F.replace(t, F.lit(token), F.lit(""))
    return F.replace(t, F.lit("'"), F.lit('"'))


def context_text(text) -> Column:
    """SCL-9: over CONTEXT_LIMIT characters -> first CONTEXT_CUT characters."""
    t = _c(text)
    return F.when(F.length(t) > CONTEXT_LIMIT, F.substring(t, 1, CONTEXT_CUT)).otherwise(t)


def format_ts(ts) -> Column:
    """SCL-10: timestamp -> ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def category_suffix(categories) -> Column:
    """SCL-6: category entities -> `` (a, b)`` or empty text."""
    c = _c(categories)
    joined = F.array_join(F.transform(c, lambda e: e.getField("description")), ", ")
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0,
                  F.concat(F.lit(" ("), joined, F.lit(")"))).otherwise(F.lit(""))


def request_output_uri(bucket, language, feature, file_system, stamp) -> Column:
    """SCL-12: ``gs://{bucket}/{lang}/{feature}/{name} - {stamp}.json``."""
    return F.concat(F.lit("gs://"), _c(bucket), F.lit("/"), _c(language), F.lit("/"),
                    _c(feature), F.lit("/"), _c(file_system), F.lit(" - "),
                    _c(stamp).cast("string"), F.lit(".json"))


def chunk_object_name(video_blobname, index, t1, t2, tag: str = TAG_TO_ANALYZE) -> Column:
    """WIN-2 naming: ``{tag}/{video}/chunks - {n} - {t1} - {t2}.mp4``."""
    return F.concat(F.lit(tag + "/"), _c(video_blobname), F.lit("/chunks - "),
                    _c(index).cast("string"), F.lit(" - "), _c(t1).cast("string"),
                    F.lit(" - "), _c(t2).cast("string"), F.lit(".mp4"))


def percent_int(x) -> Column:
    """SCL-14: fraction -> whole percent (truncated)."""
    return (_c(x) * 100).cast("int")


def js_number(x) -> Column:
    """A double as the viewer writes it: whole numbers without a fraction.

    Holds from 1e-3 to 1e7, where Java and the viewer both write plain decimals.
    """
    return F.regexp_replace(_c(x).cast("string"), r"\.0$", "")


def prompt_text(description, head: str | None = None, tail: str | None = None) -> Column:
    """PRJ-7: wrap a description into an image-prompt template (head + text + tail)."""
    return F.concat(F.lit(PROMPT_HEAD if head is None else head), _c(description),
                    F.lit(PROMPT_TAIL if tail is None else tail))


# Default prompt template around a description (our wording; pass head/tail to change it).
PROMPT_HEAD = "\n<description>\n"
PROMPT_TAIL = ("\n</description>\n<task>\n"
               "    Write a detailed prompt for generating one still image of the action described.\n"
               "    Keep to the description and avoid sensitive content.\n"
               "</task>\n")
