"""DuckDB SQL answers for the registered queries, computed from the flat tables.

The SQL never touches the nested shape: it restates each operator's rule on
``events`` / ``conversations`` / ``documents`` / ``pages`` rows, with the
same arithmetic order as the Spark side so doubles agree bit for bit.
"""

from __future__ import annotations

from shotgrid.functions import scalars as X
from shotgrid.plans import queries as Q
from shotgrid.sources import fixtures as fx

HALF = fx.HALF_MICROS


def sec(c: str) -> str:
    return f"({c} // 1000000 + ({c} % 1000000) * 1000 / 1e9)"


def lit(s: str) -> str:
    """SQL text literal; newlines via chr(10)."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


SPEECH_NAME = "CAST(conv_id AS VARCHAR)"
SPEECH_URI = f"'/bucket/speech/' || {SPEECH_NAME} || '.mp4'"
SPEECH_FILE = f"'speech/' || {SPEECH_NAME} || '.json'"

LANGS = "[" + ", ".join(f"'{x}'" for x in fx.LANG_BY_USER_MOD4) + "]"
LIK = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fx.LIKELIHOOD_BY_EVENT.items()) + " END"

EV = f"""ev AS (
  SELECT event_id, user_id, event_type, value,
         date_diff('microsecond', TIMESTAMP '{fx.EPOCH}', ts) AS off,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         least(floor(value / 10) / 10, CAST(1.0 AS DOUBLE)) AS conf,
         '/bucket/' || {LANGS}[user_id % 4 + 1] || '/' || CAST(user_id AS VARCHAR) || '.mp4' AS input_uri
  FROM events),
e2 AS (
  SELECT *, off + k * 1800000000 AS off2,
         dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS et_pos,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY off, event_id) - 1 AS j,
         count(*) OVER (PARTITION BY user_id, event_type) AS n,
         first_value(conf) OVER (PARTITION BY user_id, event_type ORDER BY off, event_id) AS conf0,
         first_value(k) OVER (PARTITION BY user_id, event_type ORDER BY off, event_id) AS k0,
         first_value(off) OVER (PARTITION BY user_id, event_type ORDER BY off, event_id) AS first_off,
         last_value(off) OVER (PARTITION BY user_id, event_type ORDER BY off, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_off,
         lead(off) OVER (PARTITION BY user_id, event_type ORDER BY off, event_id) AS next_off
  FROM ev)"""

# features some videos do not carry
SEEN = f"user_id % 7 <> {fx.NO_EXPLICIT}"
SHOWN = f"user_id % 7 <> {fx.NO_TRACKS}"

# tracks (one per user x event_type) with span, frames j at off
TRACKS = f"""tracks AS (
  SELECT DISTINCT user_id, input_uri, event_type, et_pos, n, conf0, k0,
         {sec('first_off')} AS span_start, {sec('last_off')} AS span_end
  FROM e2)"""

# a logo's two tracks: the earlier and the later half of its frames
LOGOS = f"""lf AS (
  SELECT *, CASE WHEN j < n // 2 THEN 0 ELSE 1 END AS part FROM e2 WHERE {SHOWN}),
lg AS (
  SELECT user_id, input_uri, event_type, et_pos, part,
         CASE WHEN n // 2 = 0 THEN 0 ELSE part END AS track, count(*) AS n, arg_min(conf, j) AS conf0,
         {sec('min(off)')} AS span_start, {sec('max(off)')} AS span_end
  FROM lf GROUP BY user_id, input_uri, event_type, et_pos, part, n)"""

SHOTS = f"""o AS (
  SELECT user_id, input_uri, off, event_id,
         lead(off) OVER (PARTITION BY user_id ORDER BY off, event_id) AS nxt
  FROM ev),
shots AS (
  SELECT user_id, input_uri, CASE WHEN off < {HALF} THEN 0 ELSE 1 END AS result_pos,
         {sec('off')} AS a, {sec('nxt')} AS b,
         row_number() OVER (PARTITION BY user_id, off < {HALF} ORDER BY off, event_id) AS i
  FROM o WHERE nxt IS NOT NULL)"""

PROBES = f"""probes AS (
  SELECT DISTINCT input_uri, i * CAST({Q.PROBE_STEP} AS DOUBLE) AS t
  FROM ev, range(0, {Q.PROBE_COUNT}) r(i))"""

LENGTHS = """lengths AS (
  SELECT input_uri, CAST(floor(max(off) / 1000000) + user_id % 5 AS DOUBLE) AS length
  FROM ev GROUP BY user_id, input_uri)"""


def file_of(uri: str, prefix: str = "annotations/") -> str:
    return f"'{prefix}' || regexp_extract({uri}, '([^/]+)\\.mp4$', 1) || '.json'"


def box_cols(alias: str = "") -> dict:
    p = alias
    left = f"({p}value / 1000)"
    top = f"({p}k / 1000)"
    return {
        "x": f"({left} * 800)",
        "y": f"({top} * 500)",
        "width": f"((({left} + 0.1) - {left}) * 800)",
        "height": f"((({top} + 0.1) - {top}) * 500)",
    }


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def W(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

# --- flatten ----------------------------------------------------------------

SQL["explicit_flat"] = with_(EV) + f"""
SELECT input_uri AS uri, {sec('off')} AS start, {LIK} AS explicit_content FROM ev WHERE {SEEN}"""

SQL["ocr_flat"] = with_(EV) + f"""
SELECT input_uri AS uri, {sec('off')} AS start, {sec('off2')} AS stop, event_type AS text_segment
FROM e2 WHERE j = 0 AND CAST(CAST(conf AS FLOAT) AS DOUBLE) > CAST(0.3 AS DOUBLE)"""

OCR_SEG = f"""
SELECT input_uri, et_pos AS text_pos, j AS segment_pos, event_type AS text, conf AS confidence,
       {sec('off')} AS start, {sec('off2')} AS "end", {sec('off2')} - {sec('off')} AS duration,
       k % 20 AS n_frames
FROM e2"""
SQL["ocr_all_segments"] = with_(EV) + OCR_SEG
SQL["ocr_min_frames"] = with_(EV) + f"""
SELECT *, row_number() OVER (PARTITION BY input_uri ORDER BY "end", text_pos, segment_pos) AS rank
FROM ({OCR_SEG} WHERE k % 20 >= 15) q"""

SQL["labels_flat"] = with_(EV) + f"""
SELECT input_uri AS uri, {sec('off')} AS start, {sec('off2')} AS stop, 'cat_' || event_type AS text_segment
FROM e2 WHERE CAST(CAST(conf AS FLOAT) AS DOUBLE) > CAST(0.3 AS DOUBLE)
UNION ALL
SELECT input_uri AS uri, {sec('off')} AS start, {sec('off2')} AS stop, 'all' AS text_segment
FROM e2 WHERE CAST(CAST(conf AS FLOAT) AS DOUBLE) > CAST(0.3 AS DOUBLE)"""

SQL["labels_ranked"] = with_(EV) + f"""
SELECT input_uri, dense_rank() OVER (PARTITION BY input_uri ORDER BY conf0 DESC, et_pos) AS rank,
       et_pos AS label_pos, j AS segment_pos,
       event_type || ' (cat_' || event_type || ', all)' AS label, conf0 AS first_confidence,
       conf AS confidence, {sec('off')} AS start, {sec('off2')} AS "end"
FROM e2"""

SQL["shot_labels"] = with_(EV) + """
SELECT input_uri, et_pos AS label_pos, 'cat_' || event_type || ' ' || event_type AS name,
       count(*) AS n_segments, max(conf) AS highest_confidence
FROM e2 WHERE CAST(conf AS DOUBLE) > 0.0
GROUP BY input_uri, et_pos, event_type"""

SQL["shots_enumerated"] = with_(EV, SHOTS) + """
SELECT input_uri, CAST(result_pos AS BIGINT) AS result_pos, i AS shot, a AS start, b AS "end",
       b - a AS duration FROM shots"""

SQL["tracks_over_threshold"] = with_(EV, TRACKS) + """
SELECT input_uri, et_pos AS track, event_type AS name, conf0 AS confidence,
       span_start AS start, span_end AS "end", n AS n_frames
FROM tracks WHERE CAST(conf0 AS DOUBLE) > CAST(0.5 AS DOUBLE)"""

B = box_cols()
SQL["boxes_scaled"] = with_(EV) + f"""
SELECT input_uri, et_pos AS track, j AS frame, {sec('off')} AS t,
       {B['x']} AS x, {B['y']} AS y, {B['width']} AS width, {B['height']} AS height
FROM e2"""

TEXT_FRAMES = f"""tf AS (
  SELECT input_uri, et_pos AS text_pos, event_type AS text, j AS segment_pos,
         {sec('off')} AS seg_start, {sec('off2')} AS seg_end, off, value,
         unnest(range(k % 20)) AS f
  FROM e2),
tfr AS (
  SELECT input_uri, text_pos, text, segment_pos, seg_start, seg_end, f AS frame,
         {sec('(off + f * 1000000)')} AS t,
         (value / 1000) * 800 AS x0, (f / 100) * 500 AS y0,
         ((value / 1000) + 0.1) * 800 AS x1, (f / 100) * 500 AS y1,
         ((value / 1000) + 0.1) * 800 AS x2, ((f / 100) + 0.1) * 500 AS y2,
         (value / 1000) * 800 AS x3, ((f / 100) + 0.1) * 500 AS y3
  FROM tf)"""

SQL["polygons_scaled"] = with_(EV, TEXT_FRAMES) + """
SELECT input_uri, text_pos, text, segment_pos, frame, t, x0, y0, x1, y1, x2, y2, x3, y3 FROM tfr"""

SQL["person_frames"] = with_(EV) + f"""
SELECT input_uri, et_pos AS person, conf0 AS confidence, j AS frame, {sec('off')} AS t,
       {B['x']} AS x, {B['y']} AS y, {B['width']} AS width, {B['height']} AS height
FROM e2 WHERE {SHOWN} AND conf0 > CAST(0.5 AS DOUBLE)"""

_lm_cols = []
for _name in X.LANDMARKS:
    if _name == "nose":
        _lm_cols += ["((value / 1000) + 0.05) * 800 AS nose_x", "((k / 1000) + 0.05) * 500 AS nose_y"]
    elif _name == "left_eye":
        _lm_cols += ["CASE WHEN k % 2 = 0 THEN ((value / 1000) + 0.02) * 800 END AS left_eye_x",
                     "CASE WHEN k % 2 = 0 THEN ((k / 1000) + 0.02) * 500 END AS left_eye_y"]
    else:
        _lm_cols += [f"CAST(NULL AS DOUBLE) AS {_name}_x", f"CAST(NULL AS DOUBLE) AS {_name}_y"]
SQL["landmarks_wide"] = with_(EV) + f"""
SELECT input_uri, et_pos AS person, j AS frame, {sec('off')} AS t, {', '.join(_lm_cols)}
FROM e2 WHERE {SHOWN}"""

_attr_cols = []
for _name in X.FACE_ATTRIBUTES:
    if _name == "smiling":
        _attr_cols.append("CAST(trunc(conf0 * 100) AS BIGINT) AS smiling")
    elif _name == "glasses":
        _attr_cols.append("CAST(trunc((k0 / 100) * 100) AS BIGINT) AS glasses")
    else:
        _attr_cols.append(f"CAST(NULL AS BIGINT) AS {_name}")
SQL["face_attributes"] = with_(EV, TRACKS) + f"""
SELECT input_uri, et_pos AS face, event_type || '-' || CAST(user_id AS VARCHAR) AS thumbnail,
       conf0 AS confidence, span_start AS start, span_end AS "end", {', '.join(_attr_cols)}
FROM tracks WHERE {SHOWN} AND conf0 > CAST(0.5 AS DOUBLE)"""

SQL["logo_tracks"] = with_(EV, LOGOS) + """
SELECT input_uri, et_pos AS logo, event_type AS entity_id, event_type AS name, CAST(track AS BIGINT) AS track,
       conf0 AS confidence, span_start AS start, span_end AS "end"
FROM lg WHERE conf0 > CAST(0.5 AS DOUBLE)"""

WORDS = f"""cw AS (
  SELECT conv_id, turn, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS transcription,
         list_filter(string_split_regex(coalesce(text, ''), '{fx.WORD_SPLIT}'), lambda x: x <> '') AS words
  FROM conversations),
words AS (
  SELECT {SPEECH_URI} AS input_uri, transcription,
         turn, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS word_pos, len(words) AS n_words
  FROM cw WHERE text <> ''),
wt AS (
  SELECT input_uri, transcription, word_pos, word, n_words,
         {sec('(turn * 1000000000 + word_pos * 500000)')} AS start,
         {sec('(turn * 1000000000 + word_pos * 500000 + 500000)')} AS "end"
  FROM words)"""

SQL["speech_words"] = with_(WORDS) + """
SELECT input_uri, transcription, word_pos, word, start, "end" FROM wt"""

SQL["speech_spans"] = with_(WORDS) + """
SELECT input_uri, transcription, max(n_words) AS n_words, arg_min(start, word_pos) AS start,
       arg_max("end", word_pos) AS "end"
FROM wt GROUP BY input_uri, transcription"""

def js_number(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


# the id: start, end and the points of the first kept segment's first frame, as the viewer writes numbers
_points = " || ".join(f"CASE WHEN nf > 0 THEN {js_number(c)} ELSE '' END" for c in (
    "(v / 1000) * 800", "CAST(0 AS DOUBLE) * 500", "((v / 1000) + 0.1) * 800", "CAST(0 AS DOUBLE) * 500",
    "((v / 1000) + 0.1) * 800", "(CAST(0 AS DOUBLE) + 0.1) * 500", "(v / 1000) * 800", "(CAST(0 AS DOUBLE) + 0.1) * 500"))
SQL["text_tracks"] = with_(EV) + f"""
, tt AS (
  SELECT input_uri, et_pos AS text_pos, event_type AS text,
         arg_min({sec('off')}, j) AS start, arg_max({sec('off2')}, j) AS "end",
         arg_min(value, j) AS v, arg_min(k % 20, j) AS nf
  FROM e2 WHERE conf > CAST(0.5 AS DOUBLE)
  GROUP BY input_uri, et_pos, event_type)
SELECT input_uri, row_number() OVER (PARTITION BY input_uri ORDER BY start, text_pos) AS rank, text_pos, text, start, "end",
       {js_number('start')} || {js_number('"end"')} || {_points} AS item_id
FROM tt"""

SQL["text_digest"] = with_(EV) + """
SELECT input_uri, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS digest
FROM ev GROUP BY input_uri"""

SQL["json_props"] = """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"""

SQL["json_overlay"] = """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'x' ELSE json_extract_string(props, '$.k') END AS k,
       event_type
FROM events"""
SQL["json_overlay_inner"] = SQL["json_overlay"]  # the outer record's own k is never seen

# --- scan / route -----------------------------------------------------------

_types = "[" + ", ".join(f"'{t}'" for t in Q.ARRIVAL_TYPES) + "]"
ARR = f"""arr AS (
  SELECT CAST(page_id AS VARCHAR) AS id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS bucket,
         url AS name, {_types}[page_id % 5 + 1] AS contentType,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 600) AS timeCreated
  FROM pages)"""

SQL["arrivals"] = with_(ARR) + "SELECT id, bucket, name, contentType FROM arr"

_json_types = ", ".join(f"'{t}'" for t in __import__(
    "shotgrid.sources.annotations", fromlist=["JSON_TYPES"]).JSON_TYPES)
SQL["route_arrivals"] = with_(ARR) + f"""
SELECT id, name, contentType,
       CASE WHEN contentType = 'video/mp4' AND contains(name, '.mp4') THEN 'video'
            WHEN contentType IN ({_json_types}) THEN 'json'
            WHEN contentType = 'audio/mp3' THEN 'audio'
            ELSE 'unsupported' END AS route
FROM arr"""

SQL["retention"] = with_(ARR) + f"""
SELECT id, name FROM arr
WHERE timeCreated >= TIMESTAMP '{Q.RETENTION_NOW}' - INTERVAL 86400 SECOND"""

DOCS = f"""users AS (
  SELECT input_uri, count(*) AS n_ev,
         count(*) FILTER (WHERE off < {HALF}) AS n0, count(*) FILTER (WHERE off >= {HALF}) AS n1,
         max(off) AS last_off, any_value(user_id) AS user_id
  FROM ev GROUP BY input_uri),
sh AS (
  SELECT input_uri, count(*) FILTER (WHERE result_pos = 0) AS s0,
         count(*) FILTER (WHERE result_pos = 1) AS s1
  FROM shots GROUP BY input_uri)"""

SQL["annotations_scan"] = with_(EV, SHOTS, DOCS) + f"""
SELECT CASE WHEN user_id % 11 IN ({fx.BROKEN}, {fx.HALF_BROKEN}) THEN 'quarantine' ELSE 'good' END AS state, input_uri,
       CASE WHEN user_id % 11 NOT IN ({fx.BROKEN}, {fx.HALF_BROKEN}) THEN CAST(2 AS BIGINT) END AS n_results,
       CASE WHEN user_id % 11 NOT IN ({fx.BROKEN}, {fx.HALF_BROKEN}) THEN n_ev - 1 END AS n_shots
FROM users"""

_ff = [("explicit_annotation", 0, SEEN), ("segment_label_annotations", 0, "true"), ("text_annotations", 0, "true"),
       ("shot_label_annotations", 1, "true"), ("object_annotations", 1, "true"),
       ("logo_recognition_annotations", 1, SHOWN), ("person_detection_annotations", 1, SHOWN),
       ("face_detection_annotations", 1, SHOWN)]
_ff_rows = " UNION ALL ".join(
    f"SELECT file, '{f}' AS feature, CAST({p} AS BIGINT) AS result_pos FROM d WHERE {w}" for f, p, w in _ff)
SQL["first_feature_result"] = with_(EV, SHOTS, DOCS) + f"""
, d AS (SELECT {file_of('u.input_uri')} AS file, u.user_id,
               coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1
        FROM users u LEFT JOIN sh USING (input_uri))
{_ff_rows}
UNION ALL
SELECT file, 'shot_annotations', CAST(CASE WHEN s0 > 0 THEN 0 ELSE 1 END AS BIGINT) FROM d WHERE s0 + s1 > 0
UNION ALL
SELECT DISTINCT {SPEECH_FILE}, 'speech_transcriptions', CAST(0 AS BIGINT)
FROM conversations"""

_df_rows = " UNION ALL ".join(
    f"SELECT file, '{f}' AS feature, CAST(1 AS BIGINT) AS n_results FROM d WHERE {w}" for f, _, w in _ff)
SQL["detected_features"] = with_(EV, SHOTS, DOCS) + f"""
, d AS (SELECT {file_of('u.input_uri')} AS file, u.user_id,
               coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1
        FROM users u LEFT JOIN sh USING (input_uri))
{_df_rows}
UNION ALL
SELECT file, 'shot_annotations', CAST((s0 > 0)::INT + (s1 > 0)::INT AS BIGINT) FROM d WHERE s0 + s1 > 0
UNION ALL
SELECT DISTINCT {SPEECH_FILE}, 'speech_transcriptions', CAST(1 AS BIGINT)
FROM conversations"""

SQL["misaligned"] = with_(EV, LENGTHS) + f"""
, u AS (SELECT input_uri, max(off) // 1000000 AS end_seconds FROM ev GROUP BY input_uri)
SELECT {file_of('u.input_uri')} AS file, u.input_uri, l.length,
       u.end_seconds, coalesce(abs(l.length - u.end_seconds) > 2.0, false) AS misaligned
FROM u LEFT JOIN lengths l USING (input_uri)"""

# --- chunks -----------------------------------------------------------------

CHUNKS = f"""walk(user_id, input_uri, result_pos, i, cs, b, closed) AS (
  SELECT user_id, input_uri, result_pos, i, a, b, (b - a) > {Q.CHUNK_MIN_SECONDS} FROM shots WHERE i = 1
  UNION ALL
  SELECT s.user_id, s.input_uri, s.result_pos, s.i,
         CASE WHEN w.closed THEN s.a ELSE w.cs END, s.b,
         (s.b - CASE WHEN w.closed THEN s.a ELSE w.cs END) > {Q.CHUNK_MIN_SECONDS}
  FROM walk w JOIN shots s ON s.input_uri = w.input_uri AND s.result_pos = w.result_pos AND s.i = w.i + 1),
ch AS (
  SELECT {file_of('input_uri')} AS file, result_pos, input_uri,
         row_number() OVER (PARTITION BY input_uri, result_pos ORDER BY i) AS chunk,
         row_number() OVER (PARTITION BY input_uri ORDER BY result_pos, i) AS file_chunk,
         cs AS t1, b AS t2
  FROM walk WHERE closed)"""

SQL["chunks_min_duration"] = W(EV, SHOTS, CHUNKS) + """
SELECT file, CAST(result_pos AS BIGINT) AS result_pos, input_uri, chunk, file_chunk, t1, t2 FROM ch"""


def _manifest(index: str) -> str:
    return W(EV, SHOTS, CHUNKS) + f"""
SELECT 'gs:/' || input_uri AS video_source, substr(input_uri, 9) AS video_blobname, {index} AS index,
       t1 AS time_start, t2 AS time_stop,
       'CSA/' || substr(input_uri, 9) || '/chunks - ' || CAST({index} AS VARCHAR) || ' - '
         || CAST(t1 AS VARCHAR) || ' - ' || CAST(t2 AS VARCHAR) || '.mp4' AS object_name
FROM ch"""


SQL["chunk_manifest"] = _manifest("chunk")
SQL["chunk_manifest_file_numbering"] = _manifest("file_chunk")

# --- timeline ---------------------------------------------------------------

SQL["labels_at_time"] = with_(EV, PROBES) + f"""
SELECT DISTINCT p.input_uri, p.t, e.et_pos AS label_pos, 'cat_' || e.event_type || ' ' || e.event_type AS name
FROM probes p JOIN e2 e ON p.input_uri = e.input_uri
WHERE CAST(e.conf AS DOUBLE) > 0.0 AND p.t >= {sec('e.off')} AND p.t <= {sec('e.off2')}"""

SQL["shot_at_time"] = with_(EV, SHOTS, PROBES) + """
, vs AS (SELECT *, min(result_pos) OVER (PARTITION BY input_uri) AS first_pos FROM shots)
SELECT p.input_uri, p.t, s.i AS shot, s.a AS shot_start, s.b AS shot_end
FROM probes p JOIN vs s ON p.input_uri = s.input_uri
WHERE s.result_pos = s.first_pos AND p.t >= s.a AND p.t <= s.b"""

SQL["words_at_time"] = with_(WORDS) + f"""
, wp AS (SELECT DISTINCT {SPEECH_URI} AS input_uri,
                i * CAST({Q.WORD_PROBE_STEP} AS DOUBLE) AS t
         FROM conversations, range(0, {Q.WORD_PROBE_COUNT}) r(i))
SELECT p.input_uri, p.t, w.transcription, w.word_pos, w.word
FROM wp p JOIN wt w ON p.input_uri = w.input_uri AND p.t >= w.start AND p.t <= w."end" """

FRAMEIV = f"""fiv AS (
  SELECT input_uri, et_pos AS track, n, j, {sec('off')} AS ta, {sec('next_off')} AS tb,
         value, k, lead(value) OVER w AS value_b, lead(k) OVER w AS k_b
  FROM e2 WINDOW w AS (PARTITION BY user_id, event_type ORDER BY off, event_id)),
pairs AS (
  SELECT p.input_uri, p.t, tr.et_pos AS track
  FROM probes p JOIN tracks tr ON p.input_uri = tr.input_uri
  WHERE p.t >= tr.span_start AND p.t <= tr.span_end
    AND CAST(tr.conf0 AS DOUBLE) > CAST(0.5 AS DOUBLE))"""


def _box_sql(interp: bool, where: str = "true") -> str:
    a = box_cols("f.")
    bb = {"x": "((f.value_b / 1000) * 800)", "y": "((f.k_b / 1000) * 500)",
          "width": "((((f.value_b / 1000) + 0.1) - (f.value_b / 1000)) * 800)",
          "height": "((((f.k_b / 1000) + 0.1) - (f.k_b / 1000)) * 500)"}
    r = "((pr.t - f.ta) / (f.tb - f.ta))"
    cols = []
    for c in ("x", "y", "width", "height"):
        if interp:
            cols.append(f"CASE WHEN f.j = 0 OR f.j + 1 = f.n - 1 THEN {a[c]} "
                        f"ELSE {a[c]} + ({bb[c]} - {a[c]}) * {r} END AS {c}")
        else:
            cols.append(f"{a[c]} AS {c}")
    return with_(EV, TRACKS, PROBES, FRAMEIV) + f"""
SELECT pr.input_uri, pr.t, pr.track, {', '.join(cols)}
FROM pairs pr LEFT JOIN fiv f
  ON pr.input_uri = f.input_uri AND pr.track = f.track AND f.tb IS NOT NULL
     AND pr.t >= f.ta AND pr.t < f.tb
WHERE pr.input_uri IN (SELECT input_uri FROM ev WHERE {where})"""


def _logo_sql(interp: bool) -> str:
    """The earliest listed track over the threshold that covers t, then its frames alone."""
    a = box_cols("f.")
    b = box_cols("g.")
    r = "((c.t - f.ta) / (g.ta - f.ta))"
    edge = "f.i = 0 OR f.i + 1 = c.n - 1"
    cols = [f"CASE WHEN {edge} THEN {a[c]} ELSE {a[c]} + ({b[c]} - {a[c]}) * {r} END AS {c}" if interp else
            f"CASE WHEN g.i IS NOT NULL THEN {a[c]} END AS {c}" for c in ("x", "y", "width", "height")]
    return with_(EV, LOGOS, PROBES) + f"""
, fr AS (SELECT input_uri, et_pos, part, value, k, {sec('off')} AS ta,
                row_number() OVER (PARTITION BY input_uri, et_pos, part ORDER BY off, event_id) - 1 AS i FROM lf),
cover AS (SELECT p.input_uri, p.t, l.et_pos, arg_min(l.part, l.part) AS part, arg_min(l.n, l.part) AS n
          FROM probes p JOIN lg l ON p.input_uri = l.input_uri AND p.t >= l.span_start AND p.t <= l.span_end
          WHERE l.conf0 > CAST(0.5 AS DOUBLE) GROUP BY p.input_uri, p.t, l.et_pos),
hit AS (SELECT c.input_uri, c.t, c.et_pos, c.part, c.n, max(f.i) AS i
        FROM cover c LEFT JOIN fr f ON f.input_uri = c.input_uri AND f.et_pos = c.et_pos AND f.part = c.part AND f.ta <= c.t
        GROUP BY c.input_uri, c.t, c.et_pos, c.part, c.n)
SELECT c.input_uri, c.t, c.et_pos AS track, {', '.join(cols)}
FROM hit c
LEFT JOIN fr f ON f.input_uri = c.input_uri AND f.et_pos = c.et_pos AND f.part = c.part AND f.i = c.i AND c.i + 1 < c.n
LEFT JOIN fr g ON g.input_uri = c.input_uri AND g.et_pos = c.et_pos AND g.part = c.part AND g.i = c.i + 1"""


SQL["logo_box_at_time"] = _logo_sql(True)
SQL["logo_box_at_time_real"] = _logo_sql(False)
SQL["person_box_at_time"] = _box_sql(True, SHOWN)
SQL["face_box_at_time"] = _box_sql(True, SHOWN)
SQL["box_at_time"] = _box_sql(False)
SQL["box_at_time_interp"] = _box_sql(True)

SQL["polygon_at_time"] = with_(EV, PROBES, TEXT_FRAMES) + """
, segs AS (SELECT DISTINCT input_uri, et_pos AS text_pos, event_type AS text, j AS segment_pos,
                  off // 1000000 + (off % 1000000) * 1000 / 1e9 AS seg_start,
                  off2 // 1000000 + (off2 % 1000000) * 1000 / 1e9 AS seg_end
           FROM e2 WHERE CAST(conf AS DOUBLE) > CAST(0.5 AS DOUBLE)),
firstseg AS (
  SELECT p.input_uri, p.t, s.text_pos, s.text, min(s.segment_pos) AS segment_pos
  FROM probes p JOIN segs s ON p.input_uri = s.input_uri AND p.t >= s.seg_start AND p.t <= s.seg_end
  GROUP BY p.input_uri, p.t, s.text_pos, s.text),
fv AS (
  SELECT *, count(*) OVER (PARTITION BY input_uri, text_pos, segment_pos) AS n, frame AS j,
         lead(t) OVER w AS tb,
         lead(x0) OVER w AS bx0, lead(y0) OVER w AS by0, lead(x1) OVER w AS bx1, lead(y1) OVER w AS by1,
         lead(x2) OVER w AS bx2, lead(y2) OVER w AS by2, lead(x3) OVER w AS bx3, lead(y3) OVER w AS by3
  FROM tfr WINDOW w AS (PARTITION BY input_uri, text_pos, segment_pos ORDER BY frame))
SELECT fs.input_uri, fs.t, fs.text_pos, fs.text,
""" + ",\n".join(
    f"  CASE WHEN f.j = 0 OR f.j + 1 = f.n - 1 THEN f.{c}{i} ELSE f.{c}{i} + (f.b{c}{i} - f.{c}{i}) * "
    f"((fs.t - f.t) / (f.tb - f.t)) END AS {c}{i}"
    for i in range(4) for c in ("x", "y")) + """
FROM firstseg fs LEFT JOIN fv f
  ON fs.input_uri = f.input_uri AND fs.text_pos = f.text_pos AND fs.segment_pos = f.segment_pos
     AND f.tb IS NOT NULL AND fs.t >= f.t AND fs.t < f.tb"""

SQL["landmarks_at_time"] = with_(EV, TRACKS, PROBES, FRAMEIV) + f"""
, hit AS (
  SELECT pr.input_uri, pr.t, pr.track AS person, f.*,
         (f.j = 0 OR f.j + 1 = f.n - 1) AS edge, ((pr.t - f.ta) / (f.tb - f.ta)) AS r
  FROM pairs pr JOIN fiv f
    ON pr.input_uri = f.input_uri AND pr.track = f.track AND f.tb IS NOT NULL
       AND pr.t >= f.ta AND pr.t < f.tb
  WHERE pr.input_uri IN (SELECT input_uri FROM ev WHERE {SHOWN}))
SELECT input_uri, t, person, 'nose' AS landmark,
       CASE WHEN edge THEN ((value / 1000) + 0.05) * 800
            ELSE ((value / 1000) + 0.05) * 800 + (((value_b / 1000) + 0.05) * 800 - ((value / 1000) + 0.05) * 800) * r END AS x,
       CASE WHEN edge THEN ((k / 1000) + 0.05) * 500
            ELSE ((k / 1000) + 0.05) * 500 + (((k_b / 1000) + 0.05) * 500 - ((k / 1000) + 0.05) * 500) * r END AS y
FROM hit
UNION ALL
SELECT input_uri, t, person, 'left_eye',
       CASE WHEN edge THEN ((value / 1000) + 0.02) * 800
            ELSE ((value / 1000) + 0.02) * 800 + (((value_b / 1000) + 0.02) * 800 - ((value / 1000) + 0.02) * 800) * r END,
       CASE WHEN edge THEN ((k / 1000) + 0.02) * 500
            ELSE ((k / 1000) + 0.02) * 500 + (((k_b / 1000) + 0.02) * 500 - ((k / 1000) + 0.02) * 500) * r END
FROM hit WHERE k % 2 = 0 AND (edge OR k_b % 2 = 0)"""

SQL["likelihood_at_time"] = with_(EV, PROBES) + f"""
, fr AS (
  SELECT input_uri, {sec('off')} AS ta, {LIK} AS v,
         lead({sec('off')}) OVER (PARTITION BY input_uri ORDER BY off, event_id) AS tb,
         row_number() OVER (PARTITION BY input_uri ORDER BY off, event_id) AS rn
  FROM ev WHERE {SEEN}),
firsts AS (SELECT input_uri, ta AS t0, v AS v0 FROM fr WHERE rn = 1)
SELECT p.input_uri, p.t,
       coalesce(f.v, CASE WHEN p.t < fi.t0 THEN fi.v0 END, '') AS likelihood
FROM probes p LEFT JOIN firsts fi ON p.input_uri = fi.input_uri
LEFT JOIN fr f ON p.input_uri = f.input_uri AND f.tb IS NOT NULL AND p.t >= f.ta AND p.t < f.tb"""

SQL["timeline_pct"] = with_(EV, LENGTHS) + f"""
SELECT e.input_uri, e.et_pos AS label_pos, e.j AS segment_pos,
       {sec('e.off')} / l.length * 100 AS left_pct,
       ({sec('e.off2')} - {sec('e.off')}) / l.length * 100 AS width_pct
FROM e2 e JOIN lengths l ON e.input_uri = l.input_uri
WHERE CAST(e.conf AS DOUBLE) > 0.0"""

_PCT = """t.span_start / l.length * 100 AS left_pct,
       (t.span_end - t.span_start) / l.length * 100 AS width_pct
FROM tracks t JOIN lengths l ON t.input_uri = l.input_uri
WHERE CAST(t.conf0 AS DOUBLE) > CAST(0.5 AS DOUBLE)"""
SQL["timeline_pct_objects"] = with_(EV, TRACKS, LENGTHS) + f"""
SELECT t.input_uri, t.et_pos AS track, t.event_type AS name, {_PCT}"""
SQL["timeline_pct_persons"] = with_(EV, TRACKS, LENGTHS) + f"""
SELECT t.input_uri, t.et_pos AS person, {_PCT} AND t.{SHOWN}"""
SQL["timeline_pct_explicit"] = with_(EV, LENGTHS) + f"""
SELECT f.input_uri, f.frame_pos, f.explicit_content, f.start / l.length * 100 AS left_pct
FROM (SELECT input_uri, {sec('off')} AS start, {LIK} AS explicit_content,
             row_number() OVER (PARTITION BY input_uri ORDER BY off, event_id) - 1 AS frame_pos
      FROM ev WHERE {SEEN}) f JOIN lengths l ON f.input_uri = l.input_uri"""

# --- summaries --------------------------------------------------------------

def _segments_sql(source: str, ctes: tuple, order: str) -> str:
    return with_(*ctes) + f"""
SELECT input_uri, event_type AS name, count(*) AS n_tracks,
       string_agg(CAST(span_start AS VARCHAR) || '-' || CAST(span_end AS VARCHAR), ';' ORDER BY {order}) AS segments
FROM {source} WHERE conf0 > CAST(0.5 AS DOUBLE)
GROUP BY input_uri, event_type"""


def _merged_sql(source: str, ctes: tuple) -> str:
    return with_(*ctes) + f"""
, s AS (SELECT input_uri, event_type AS name, span_start AS st, span_end AS en
        FROM {source} WHERE conf0 > CAST(0.5 AS DOUBLE)),
f AS (SELECT *, max(en) OVER (PARTITION BY input_uri, name ORDER BY st, en
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM s),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR st >= pm THEN 1 ELSE 0 END)
                 OVER (PARTITION BY input_uri, name ORDER BY st, en
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
SELECT input_uri, name, min(st) AS seg_start, max(en) AS seg_end, count(*) AS n_merged
FROM g GROUP BY input_uri, name, island"""


SQL["track_segments"] = _segments_sql("tracks", (EV, TRACKS), "et_pos")
SQL["logo_segments"] = _segments_sql("lg", (EV, LOGOS), "et_pos, part")
SQL["track_segments_merged"] = _merged_sql("tracks", (EV, TRACKS))
SQL["logo_segments_merged"] = _merged_sql("lg", (EV, LOGOS))


def _one_key_sql(key: str) -> str:
    return with_(EV, TRACKS) + f"""
, v AS (SELECT DISTINCT input_uri FROM ev)
SELECT v.input_uri, '{key}' AS key, count(t.et_pos) AS n_tracks,
       coalesce(string_agg(CAST(t.span_start AS VARCHAR) || '-' || CAST(t.span_end AS VARCHAR), ';'
                           ORDER BY t.et_pos), '') AS segments
FROM v LEFT JOIN tracks t ON v.input_uri = t.input_uri AND t.conf0 > CAST(0.5 AS DOUBLE) AND {SHOWN}
GROUP BY v.input_uri"""


SQL["person_segments"] = _one_key_sql("person")
SQL["face_segments"] = _one_key_sql("face")

_buckets = ", ".join(f"('{b}')" for b in __import__(
    "shotgrid.operators.summaries", fromlist=["LIKELIHOOD_BUCKETS"]).LIKELIHOOD_BUCKETS)
SQL["likelihood_buckets"] = with_(EV) + f"""
, v AS (SELECT DISTINCT input_uri FROM ev WHERE {SEEN}),
b(likelihood) AS (VALUES {_buckets}),
fr AS (SELECT input_uri, {LIK} AS v, {sec('off')} AS t, off, event_id FROM ev)
SELECT v.input_uri, b.likelihood, count(fr.t) AS n_frames,
       coalesce(string_agg(CAST(fr.t AS VARCHAR), ';' ORDER BY fr.off, fr.event_id), '') AS times
FROM v CROSS JOIN b LEFT JOIN fr ON fr.input_uri = v.input_uri AND fr.v = b.likelihood
GROUP BY v.input_uri, b.likelihood"""

SQL["frames_by_likelihood"] = with_(EV) + f"""
SELECT input_uri, CAST(0 AS BIGINT) AS result_pos, count(*) FILTER (WHERE event_type = 'purchase') AS n_frames
FROM ev WHERE {SEEN} GROUP BY input_uri"""

# --- catalogue --------------------------------------------------------------

RES = f"""res AS (
  SELECT CAST(doc_id AS VARCHAR) AS index, CAST(doc_id * 2.5 AS VARCHAR) AS time_start,
         CAST(doc_id * 2.5 + 2.5 AS VARCHAR) AS time_stop, source AS video_blobname,
         'gs://in/' || source || '.mp4' AS video_source,
         CASE WHEN doc_id % 7 = 0 THEN 'ERROR' WHEN doc_id % 7 = 1 THEN 'ERROR: ' || lang ELSE text END
           AS description,
         '{Q.RUN_TS}' AS update_time,
         'gs://out/CSA/' || source || '/chunks - ' || CAST(doc_id AS VARCHAR) || '.mp4' AS uri,
         doc_id
  FROM documents WHERE doc_id % 10 <> 0)"""

SQL["results_with_tags"] = with_(RES) + """
SELECT index, time_start, time_stop, video_blobname, video_source, description, update_time, uri FROM res"""
SQL["results_roundtrip"] = SQL["results_with_tags"]
SQL["results_typed"] = with_(RES) + """
SELECT CAST(index AS BIGINT) AS index, CAST(time_start AS DOUBLE) AS time_start,
       CAST(time_stop AS DOUBLE) AS time_stop, video_blobname, video_source, description,
       update_time, uri FROM res"""
SQL["movie_list"] = with_(RES) + "SELECT DISTINCT video_blobname FROM res"
_md = f"""
SELECT index, time_start AS start, time_stop AS stop, description, uri, CAST(NULL AS VARCHAR) AS llm_model
FROM res WHERE video_blobname = '{Q.MOVIE}' AND description <> 'ERROR'
ORDER BY CAST(index AS BIGINT)"""
SQL["movie_description"] = with_(RES) + _md
SQL["movie_description_top"] = with_(RES) + _md + f" LIMIT {Q.TOP_N}"
SQL["filter_limit"] = """
SELECT doc_id, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100"""
SQL["pending_only"] = with_(RES) + """
SELECT uri, description FROM res
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""
SQL["prompt_template"] = f"""
SELECT 'gs://out/CSA/' || source || '/chunks - ' || CAST(doc_id AS VARCHAR) || '.mp4' AS uri,
       {lit(X.PROMPT_HEAD)} || text || {lit(X.PROMPT_TAIL)} AS prompt FROM documents"""
SQL["scored"] = """
SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS VARCHAR) || ' words' AS result,
       CAST(NULL AS VARCHAR) AS error, CAST(1 + length(text) % 2 AS BIGINT) AS attempts,
       CASE WHEN length(text) % 2 = 1 THEN 'backup' ELSE 'primary' END AS endpoint
FROM documents"""

SQL["scored_by_name"] = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN 'ERROR: no input' ELSE '{"words": ' || CAST(n AS VARCHAR) || '}' END AS result,
       CAST(n AS BIGINT) AS words, CASE WHEN text IS NULL THEN 'no input' END AS error,
       CAST(coalesce(1 + length(text) % 2, 0) AS BIGINT) AS attempts,
       CASE WHEN length(text) % 2 = 1 THEN 'backup' WHEN text IS NOT NULL THEN 'primary' END AS endpoint
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS n FROM documents)"""

_feats = "[" + ", ".join(f"'{f}'" for f in X.FEATURES) + "]"
_VIDEOS = f"""v AS (SELECT DISTINCT 'gs:/' || input_uri AS input_uri, {LANGS}[user_id % 4 + 1] AS language_code,
               CAST(user_id AS VARCHAR) AS file_system FROM ev)"""


def _manifest_sql(features: str) -> str:
    return with_(EV, _VIDEOS) + f"""
SELECT input_uri, feature, language_code, file_system,
       'gs://{Q.WORKING_BUCKET}/' || language_code || '/' || feature || '/' || file_system
         || ' - {Q.REQUEST_STAMP}.json' AS output_uri
FROM (SELECT *, unnest({features}) AS feature FROM v) q"""


SQL["request_manifest"] = _manifest_sql("['SHOT_CHANGE_DETECTION']")  # the pipeline's one active feature
SQL["request_manifest_features"] = _manifest_sql(_feats)
SQL["request_manifest_unsplit"] = with_(EV, _VIDEOS) + f"""
SELECT input_uri, {_feats} AS features, language_code, file_system,
       'gs://{Q.WORKING_BUCKET}/' || language_code || '/' || file_system || ' - {Q.REQUEST_STAMP}.json' AS output_uri
FROM v"""

# --- scalars ----------------------------------------------------------------

URIS = """uris AS (
  SELECT 'gs://out/CSA/' || source || '/chunks - ' || CAST(doc_id AS VARCHAR) || '.mp4' AS u
  FROM documents
  UNION ALL SELECT url FROM pages)"""
_gs = "'^gs://([^/]+)/(.+)$'"
SQL["uri_parts"] = with_(URIS) + f"""
SELECT u AS uri,
       CASE WHEN regexp_matches(u, {_gs}) THEN regexp_extract(u, {_gs}, 1) END AS bucket,
       CASE WHEN regexp_matches(u, {_gs}) THEN regexp_extract(u, {_gs}, 2) END AS blob,
       CASE WHEN regexp_matches(u, {_gs}) THEN replace(regexp_extract(u, {_gs}, 2), '/', '_') END AS local_name
FROM uris"""
SQL["path_names"] = with_(URIS) + r"""
SELECT u AS uri, regexp_replace(u, '^((?:.*/)?\.*[^/.][^/]*)\.[^./]*$', '\1') || '.json' AS json_name,
       regexp_extract(split_part(u, '.', 1), '[^/]*$') AS base_name,
       substr(u, 1, length(u) - 1) || '3' AS audio_name
FROM uris"""

_codes = "[" + ", ".join(f"'{c}'" for c in X.LANGUAGE_CODES) + "]"
_case = "CASE " + " ".join(f"WHEN contains(uri, '{c}') THEN '{c}'"
                           for c in reversed(X.LANGUAGE_CODES)) + f" ELSE '{X.DEFAULT_LANGUAGE}' END"
SQL["language_code"] = f"""
WITH u AS (SELECT DISTINCT user_id FROM events),
v AS (SELECT user_id, '/bucket/' || {LANGS}[user_id % 4 + 1] || '/' || {_codes}[user_id % {len(X.LANGUAGE_CODES)} + 1]
             || '.mp4' AS uri FROM u)
SELECT user_id, uri, {_case} AS language_code FROM v"""

SQL["clean_json"] = """
SELECT page_id, replace(replace(replace(replace(html, 'json', ''), 'JSON', ''), '```', ''), '''', '"') AS cleaned
FROM pages"""
SQL["context_text"] = f"""
SELECT doc_id, CASE WHEN length(text) > {X.CONTEXT_LIMIT} THEN substring(text, 1, {X.CONTEXT_CUT}) ELSE text END AS context
FROM documents"""
SQL["format_ts"] = """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts_text FROM orders"""
_fn = "CASE k % 16 " + " ".join(f"WHEN {n} THEN '{name}'" for name, n in X.FEATURE_NUMBERS.items()) + \
    " ELSE 'UNKNOWN' END"
SQL["feature_name"] = with_(EV) + f"SELECT event_id, {_fn} AS feature FROM ev"

SQL["embeddings_typed"] = with_(RES) + """
SELECT r.video_source, r.description, CAST(e.embedding AS DOUBLE[]) AS embeddings,
       CAST(r.index AS BIGINT) AS index, CAST(r.time_start AS DOUBLE) AS start,
       CAST(r.time_stop AS DOUBLE) AS stop
FROM res r JOIN embeddings e ON e.vec_id = r.doc_id"""


_ctx = f"CASE WHEN length(description) > {X.CONTEXT_LIMIT} THEN substring(description, 1, {X.CONTEXT_CUT}) ELSE description END"
SQL["embeddings_from_model"] = with_(RES) + f"""
SELECT video_source, description, [CAST(n AS DOUBLE), CAST(b AS DOUBLE)] AS embeddings, CAST(index AS BIGINT) AS index,
       CAST(0 AS DOUBLE) AS start, CAST(n AS DOUBLE) AS stop
FROM (SELECT *, length({_ctx}) AS n, length({_ctx}) - length(replace({_ctx}, ' ', '')) AS b FROM res) q"""


def oracle_sql() -> dict[str, str]:
    keys = Q.queries().keys()
    return {k: v for k, v in SQL.items() if k in keys}
