"""Shot chunking: minimum-length merge (WIN-1), chunk manifest (WIN-2/3),
one piece per shot (WIN-4).

Where the shots of an annotation result lie in one document row, the
sequential merge needs no shuffle: document rows are scanned where they were
read, with ``mapInArrow`` (Arrow batches of bounded bytes in and out). Only the
shot times cross into Python, as flat buffers; the loop runs over chunks. Videos
stored in parts (``sources.parts``) pass the rule's state from part to part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.functions.scalars import chunk_object_name, segment_end, segment_start, split_gs_uri
from shotgrid.session import bounded_batches

CHUNK_SCHEMA = ("file string, result_pos int, input_uri string, chunk int, file_chunk int, "
                "t1 double, t2 double")

DEFAULT_MIN_SECONDS = 5.0


def merge_min_duration(starts, ends, min_seconds, opened=None):
    """The sequential rule. Yields (t1, t2) per closed chunk.

    A chunk opens at the first shot after a close and closes at the first
    shot whose end minus the chunk start is strictly above ``min_seconds``;
    gaps between shots are included and an unclosed tail is dropped. Where ends
    never fall (shots in time order) the closing shot is found by bisection, so
    the work follows the chunks, not the shots. ``opened`` is the start of a chunk
    that shots before these left open.
    """
    starts, ends = np.asarray(starts, float), np.asarray(ends, float)
    rising = bool((ends[1:] >= ends[:-1]).all())
    i, n = 0, len(ends)
    while i < n:
        a = starts[i] if opened is None else opened
        opened = None
        k = _closing(ends, i, a, min_seconds, rising)
        if k == n:
            return
        yield float(a), float(ends[k])
        i = k + 1


def _closing(ends: np.ndarray, i: int, a: float, min_seconds: float, rising: bool) -> int:
    """The first shot from i on that closes a chunk opened at a; the number of shots if none does."""
    n = len(ends)
    k = max(i, int(np.searchsorted(ends, a + min_seconds, "left")) - 1) if rising else i
    while k > i and ends[k - 1] - a > min_seconds:  # the sum above may round
        k -= 1
    while k < n and not ends[k] - a > min_seconds:
        k += 1
    return k


# --- the rule over parts ----------------------------------------------------
# A part of the shots maps the state before it (the start of the open chunk, or none) to the state after it
# and the number of chunks it closes. An open chunk closes at the first shot whose end lies far enough behind
# its start, and from there on everything is settled, so the map is a table of steps over the running maximum
# of the ends. Maps are small, and following them through the parts in order gives every part its state.

def part_map(starts, ends, min_seconds: float) -> tuple[list, list, list, float | None, int]:
    """(limits, states, counts, fresh state, fresh count) of a part.

    An open chunk with start a ends up in the state and count of the first limit with
    ``limit - a > min_seconds``; without one it stays open. ``fresh``: no chunk was open.
    """
    starts, ends = np.asarray(starts, float), np.asarray(ends, float)
    rising = bool((ends[1:] >= ends[:-1]).all())
    n = len(ends)
    state: list = [None] * (n + 1)                  # after a fresh start at each shot
    count = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        k = _closing(ends, i, starts[i], min_seconds, rising)
        state[i], count[i] = (float(starts[i]), 0) if k == n else (state[k + 1], count[k + 1] + 1)
    limits, states, counts = [], [], []
    highest = -np.inf
    for k in range(n):
        if ends[k] > highest:
            highest = float(ends[k])
            if limits and (states[-1], counts[-1]) == (state[k + 1], count[k + 1] + 1):
                limits[-1] = highest
            else:
                limits.append(highest)
                states.append(state[k + 1])
                counts.append(count[k + 1] + 1)
    return limits, states, counts, state[0], count[0]


def follow(mapped: tuple, opened: float | None, min_seconds: float) -> tuple[float | None, int]:
    """The state after a part, and the chunks it closes, from the state before it."""
    limits, states, counts, fresh, n_fresh = mapped
    if opened is None:
        return fresh, n_fresh
    for limit, state, n in zip(limits, states, counts):
        if limit - opened > min_seconds:
            return state, n
    return opened, 0


MAP_SCHEMA = ("file string, result_pos int, part long, limits array<double>, states array<double>, counts array<long>, "
              "fresh double, n_fresh long")
STATE_SCHEMA = "file string, result_pos int, part long, opened double, before long, file_before long"


def _maps(min_seconds: float):
    def run(batches):
        for rb in batches:
            offsets = rb.column("starts").offsets.to_numpy()
            starts, ends = (rb.column(c).values.to_numpy(zero_copy_only=False) for c in ("starts", "ends"))
            maps = [part_map(starts[a:b], ends[a:b], min_seconds) for a, b in zip(offsets, offsets[1:])]
            limits, states, counts, fresh, n_fresh = zip(*maps) if maps else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [rb.column("file"), rb.column("result_pos"), rb.column("part"), pa.array(limits, pa.list_(pa.float64())),
                 pa.array(states, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int64())),
                 pa.array(fresh, pa.float64()), pa.array(n_fresh, pa.int64())],
                ["file", "result_pos", "part", "limits", "states", "counts", "fresh", "n_fresh"])
    return run


def _scan(min_seconds: float):
    """Follows the maps of each file in the order of its parts."""
    def run(batches):
        file = result = opened = None
        before = in_file = 0
        for rb in batches:
            out = []
            for f, r, part, *mapped in zip(*(c.to_pylist() for c in rb.columns)):
                if f != file:
                    file, result, in_file = f, None, 0
                if r != result:
                    result, opened, before = r, None, 0
                out.append((f, r, part, opened, before, in_file))
                opened, n = follow(mapped, opened, min_seconds)
                before, in_file = before + n, in_file + n
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate(
                    (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                ["file", "result_pos", "part", "opened", "before", "file_before"])
    return run


def _part_chunks(min_seconds: float):
    """The chunks a part closes, numbered from those closed before it."""
    def run(batches):
        for rb in batches:
            offsets = rb.column("starts").offsets.to_numpy()
            starts, ends = (rb.column(c).values.to_numpy(zero_copy_only=False) for c in ("starts", "ends"))
            opened, before, in_file = (rb.column(c).to_pylist() for c in ("opened", "before", "file_before"))
            rows, cols = [], ([], [], [], [])
            for row, (a, b) in enumerate(zip(offsets, offsets[1:])):
                for k, (t1, t2) in enumerate(merge_min_duration(starts[a:b], ends[a:b], min_seconds, opened[row]), 1):
                    rows.append(row)
                    for col, v in zip(cols, (before[row] + k, in_file[row] + k, t1, t2)):
                        col.append(v)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rb.column("file").take(at), rb.column("result_pos").take(at), rb.column("input_uri").take(at),
                 pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()),
                 pa.array(cols[3], pa.float64())],
                ["file", "result_pos", "input_uri", "chunk", "file_chunk", "t1", "t2"])
    return run


def min_duration_chunks_of_parts(parts: DataFrame, min_seconds: float = DEFAULT_MIN_SECONDS) -> DataFrame:
    """WIN-1 over shots in parts (``sources.parts``): the same rows as over whole documents, for any part size.

    A file of one part is a whole document. Of the others one small map row a part and result
    is dealt by file and followed in order; a part then makes its chunks from its own shots
    and the state before it.
    """
    from shotgrid.sources.parts import result_rows
    whole = min_duration_chunks(parts.where("n_parts = 1"), min_seconds)
    rows = result_rows(parts.where("n_parts > 1"))
    times = rows.select("file", "result_pos", "input_uri", "part", F.transform("items", segment_start).alias("starts"),
                         F.transform("items", segment_end).alias("ends"))
    maps = times.drop("input_uri").mapInArrow(_maps(float(min_seconds)), MAP_SCHEMA)
    states = maps.repartition("file").sortWithinPartitions("file", "result_pos", "part") \
        .mapInArrow(_scan(float(min_seconds)), STATE_SCHEMA)
    cut = times.join(states, ["file", "result_pos", "part"]).mapInArrow(_part_chunks(float(min_seconds)), CHUNK_SCHEMA)
    return whole.unionByName(cut)


def _inner(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of a list of lists of doubles, and the numbers, as flat buffers."""
    inner = lists.values
    return lists.offsets.to_numpy(), inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)


def _chunk_batches(min_seconds: float):
    out_schema = pa.schema([("file", pa.string()), ("result_pos", pa.int32()),
                            ("input_uri", pa.string()), ("chunk", pa.int32()),
                            ("file_chunk", pa.int32()), ("t1", pa.float64()),
                            ("t2", pa.float64())])

    def run(batches):
        for rb in batches:
            results, bounds, starts = _inner(rb.column("starts"))
            _, _, ends = _inner(rb.column("ends"))
            uris = rb.column("uris")
            rows, uri_at, cols = [], [], ([], [], [], [], [])
            for row in range(rb.num_rows):
                n_file = 0
                for pos in range(results[row + 1] - results[row]):
                    a, b = bounds[results[row] + pos], bounds[results[row] + pos + 1]
                    for n_res, (t1, t2) in enumerate(merge_min_duration(starts[a:b], ends[a:b], min_seconds), 1):
                        n_file += 1
                        rows.append(row)
                        uri_at.append(int(uris.offsets[row].as_py()) + pos)
                        for col, v in zip(cols, (pos, n_res, n_file, t1, t2)):
                            col.append(v)
            pos, n_res, n_file, t1, t2 = cols
            yield pa.RecordBatch.from_arrays(
                [rb.column("file").take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()),
                 uris.values.take(pa.array(uri_at, pa.int64())), pa.array(n_res, pa.int32()),
                 pa.array(n_file, pa.int32()), pa.array(t1, pa.float64()), pa.array(t2, pa.float64())], schema=out_schema)

    return run


def min_duration_chunks(docs: DataFrame, min_seconds: float = DEFAULT_MIN_SECONDS) -> DataFrame:
    """WIN-1 over every result of every document.

    Output: file, result_pos, input_uri, chunk (1-based within the result),
    file_chunk (1-based, continuing across the results of one file), t1, t2.
    """
    empty = F.array().cast("array<double>")
    shots = F.col("annotation_results.shot_annotations")  # prunes the read to shots only
    prepared = docs.select(
        "file",
        F.col("annotation_results.input_uri").alias("uris"),
        F.transform(shots, lambda s: F.coalesce(F.transform(s, segment_start), empty)).alias("starts"),
        F.transform(shots, lambda s: F.coalesce(F.transform(s, segment_end), empty)).alias("ends")) \
        .where(F.col("starts").isNotNull())
    bounded_batches(docs.sparkSession)
    return prepared.mapInArrow(_chunk_batches(float(min_seconds)), CHUNK_SCHEMA)


def chunk_manifest(chunks: DataFrame, numbering: str = "result") -> DataFrame:
    """WIN-2 / WIN-3: chunk object names and their tags.

    ``numbering="result"`` restarts the index for every result (the live path);
    ``"file"`` continues it across the results of a file.
    """
    index = F.col("chunk") if numbering == "result" else F.col("file_chunk")
    source = F.concat(F.lit("gs:/"), F.col("input_uri"))
    parts = split_gs_uri(source)
    return chunks.select(
        source.alias("video_source"),
        parts["blob"].alias("video_blobname"),
        index.alias("index"),
        F.col("t1").alias("time_start"),
        F.col("t2").alias("time_stop"),
        chunk_object_name(parts["blob"], index, F.col("t1"), F.col("t2")).alias("object_name"))


def shots_of_parts(parts: DataFrame) -> DataFrame:
    """NST-7 / WIN-4 / PRJ-3 over shots in parts: a shot's number is its part's base and its place there."""
    from shotgrid.sources.parts import result_rows
    shots = result_rows(parts).select("result_pos", "input_uri", "base", F.posexplode("items").alias("pos", "s"))
    start, end = segment_start(F.col("s")), segment_end(F.col("s"))
    return shots.select("input_uri", "result_pos", (F.col("base") + F.col("pos") + 1).alias("shot"),
                        start.alias("start"), end.alias("end"), (end - start).alias("duration"))


def shots_enumerated(docs: DataFrame, first_result_only: bool = False) -> DataFrame:
    """NST-7 / WIN-4: one row per shot, 1-based number, start, end, duration."""
    from shotgrid.operators.flatten import feature_rows
    rows = feature_rows(docs, "shot_annotations", "first" if first_result_only else "all")
    if first_result_only:
        rows = rows.withColumn("result_pos", F.lit(None).cast("int"))
    shots = rows.select("file", "result_pos", "input_uri",
                        F.posexplode("items").alias("pos", "s"))
    start, end = segment_start(F.col("s")), segment_end(F.col("s"))
    return shots.select("input_uri", "result_pos", (F.col("pos") + 1).alias("shot"),
                        start.alias("start"), end.alias("end"), (end - start).alias("duration"))
