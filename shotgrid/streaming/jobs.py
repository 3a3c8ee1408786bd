"""Structured Streaming jobs over object arrivals (STR-1..5).

* STR-1 ``start_request_job``: arrival records -> FLT-1 route -> JN-2 request
  manifest.
* STR-2 ``start_annotation_job``: annotation JSON files -> chunk manifest and
  the three flat tables. Each output is guarded: one that fails is recorded in
  the ``errors`` table and stops none of the others. Broken files go to a
  quarantine table.
* STR-3 ``start_classify_job``: chunk manifest files -> caller-supplied model
  (``enrich.score_once``), run once per chunk and stored: a batch has a ledger of its
  finished calls, so that a lost executor or a replayed batch pays for none of them again,
  and an object written anew in a later batch is called anew; results, failures, the text
  beside the source and the embeddings of tagged chunks are all read from that.
  Only mp4 objects are scored; outputs never re-enter the input.
  Tags are those of the time of a batch; results whose object has none yet wait in
  ``_untagged`` for the next batch.
* STR-4 retention: ``cleanSource`` removes or archives read files (the bucket
  lifecycle rule removes *stored* objects; an unread file is never skipped
  unless a caller sets ``max_file_age``); ``expire_intermediates`` removes the
  stored intermediates of older batches.
* STR-5 delivery: every output lies under ``run=<id>/batch_id=<n>`` and is
  written with overwrite. The run id is kept beside the checkpoint, so a replayed
  batch replaces itself and a fresh checkpoint never touches older output.

Each annotation file holds all shots of its results, so no cross-batch state
is needed. ``max_files`` bounds a micro-batch.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shotgrid import schema as S
from shotgrid.operators import catalog, chunks, enrich, flatten
from shotgrid.sources import annotations as A
from shotgrid.sources import sinks

CORRUPT = A.CORRUPT


MAX_FILES = 1_000  # of a micro-batch
INTERMEDIATES = ("_parsed", "_scored", "_tags", "_untagged", "_called", "_embedded")
RETENTION_SECONDS = 86_400


def _file_stream(spark: SparkSession, fmt: str, schema, path: str, max_file_age: str | None,
                 clean_source: str | None, max_files: int, **options) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if max_file_age:
        r = r.option("maxFileAge", max_file_age)
    if clean_source:
        r = r.option("cleanSource", clean_source)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def annotation_stream(spark: SparkSession, input_dir: str, max_file_age: str | None = None,
                      clean_source: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Annotation JSON files as a stream; file path taken from ``_metadata``."""
    raw = _file_stream(spark, "json", S.annotation_schema(CORRUPT), input_dir, max_file_age,
                       clean_source, max_files, multiLine="true", mode="PERMISSIVE",
                       columnNameOfCorruptRecord=CORRUPT)
    return raw.select(F.col("_metadata.file_path").alias("file"), "annotation_results", CORRUPT)


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of all runs on one checkpoint, made when the checkpoint is new."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}-run")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    new = not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(checkpoint))
    if new or not fs.exists(path):
        fs.delete(path, True)
        name = uuid.uuid4().hex
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path, name))
        return name
    return fs.listStatus(path)[0].getPath().getName()


def _write_batch(df: DataFrame, out_dir: str, table: str, run: str, batch_id: int) -> str:
    path = f"{out_dir}/{table}/run={run}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def _guarded(outputs: dict[str, Callable[[], DataFrame]], spark: SparkSession, out_dir: str, run: str,
             batch_id: int) -> None:
    """Write each output on its own; failures become rows of ``errors``."""
    errors = []
    for table, build in outputs.items():
        try:
            _write_batch(build(), out_dir, table, run, batch_id)
        except Exception as e:  # noqa: BLE001 - one output must not stop the others
            errors.append((table, str(e)[:2000]))
    if errors:
        _write_batch(spark.createDataFrame(errors, "output string, error string"), out_dir, "errors", run, batch_id)


def annotation_outputs(good: DataFrame, min_seconds: float) -> dict[str, Callable[[], DataFrame]]:
    """The tables STR-2 makes of good documents."""
    return {
        "chunks": lambda: chunks.chunk_manifest(chunks.min_duration_chunks(good, min_seconds)),
        "explicit": lambda: flatten.explicit_flat(good),
        "ocr": lambda: flatten.ocr_flat(good),
        "labels": lambda: flatten.labels_flat(good),
    }


def annotation_batch(out_dir: str, min_seconds: float, run: str = "0",
                     outputs: Callable = annotation_outputs) -> Callable[[DataFrame, int], None]:
    """foreachBatch body of STR-2: the batch is parsed once, stored, and read for each output."""

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(_write_batch(batch, out_dir, "_parsed", run, batch_id))
        bad = F.col(CORRUPT).isNotNull() | F.col("annotation_results").isNull()
        good = stored.where(~bad).drop(CORRUPT)
        quarantine = {"quarantine": lambda: stored.where(bad).select("file", F.col(CORRUPT).alias("record"))}
        _guarded(quarantine | outputs(good, min_seconds), spark, out_dir, run, batch_id)

    return body


def _start(w, available_now: bool) -> StreamingQuery:
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_annotation_job(spark: SparkSession, input_dir: str, out_dir: str, checkpoint: str,
                         min_seconds: float = chunks.DEFAULT_MIN_SECONDS,
                         available_now: bool = True, max_file_age: str | None = None,
                         clean_source: str | None = None, max_files: int = MAX_FILES,
                         outputs: Callable = annotation_outputs) -> StreamingQuery:
    """STR-2 (+ STR-4, STR-5)."""
    run = run_id(spark, checkpoint)
    return _start(annotation_stream(spark, input_dir, max_file_age, clean_source, max_files).writeStream
                  .foreachBatch(annotation_batch(out_dir, min_seconds, run, outputs))
                  .option("checkpointLocation", checkpoint), available_now)


def start_request_job(spark: SparkSession, arrivals_dir: str, out_dir: str, checkpoint: str,
                      working_bucket: str, stamp: str, features: list[str] | None = None,
                      available_now: bool = True, max_file_age: str | None = None,
                      clean_source: str | None = None, max_files: int = MAX_FILES) -> StreamingQuery:
    """STR-1: arrival records -> route -> one request row per video x feature."""
    arrivals = _file_stream(spark, "json", S.ARRIVAL, arrivals_dir, max_file_age, clean_source, max_files)
    videos = A.route(arrivals).where(F.col("route") == "video").select(
        F.concat(F.lit("gs://"), F.col("bucket"), F.lit("/"), F.col("name")).alias("input_uri"))
    manifest = catalog.request_manifest(videos, working_bucket, stamp, features)
    return _start(manifest.writeStream.format("parquet").option("path", out_dir)
                  .option("checkpointLocation", checkpoint), available_now)


def start_classify_job(spark: SparkSession, manifest_dir: str, tags: DataFrame | str | Callable, out_dir: str,
                       checkpoint: str, model: Callable, endpoints: list[str],
                       manifest_schema: str, max_passes: int = 3, available_now: bool = True,
                       embed: Callable | None = None, run_ts: str | None = None,
                       max_file_age: str | None = None, clean_source: str | None = None,
                       max_files: int = MAX_FILES) -> StreamingQuery:
    """STR-3: describe each mp4 chunk once; results and embeddings of tagged chunks, texts, failures.

    ``embed(context, endpoint)`` gives an embedding response: a list of
    (start_offset_sec, end_offset_sec, vector). ``run_ts`` stamps the results
    (now, if not given). ``tags`` as a path, or a function of the session, are read anew
    in every batch; a DataFrame is a fixed set.
    """
    m = _file_stream(spark, "parquet", manifest_schema, manifest_dir, max_file_age, clean_source, max_files)
    mp4 = m.where(F.col("object_name").endswith(".mp4"))
    run = run_id(spark, checkpoint)
    stamp = run_ts or time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())

    def body(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        finished = f"{out_dir}/{{}}/run={run}/batch_id={batch_id}".format
        scored = enrich.score_once(batch.select(F.col("object_name").alias("uri")), model, "uri", finished("_called"),
                                   endpoints=endpoints, max_passes=max_passes)
        stored = session.read.parquet(_write_batch(scored, out_dir, "_scored", run, batch_id))
        described = stored.select("uri", F.col("result").alias("description"), "error")

        waiting = described.select("uri", "description")
        earlier = f"{out_dir}/_untagged/run={run}/batch_id={batch_id - 1}"
        if _exists(session, earlier):
            waiting = waiting.unionByName(session.read.parquet(earlier))
        # one state of the tags for all outputs of the batch
        wanted = typed_tags(current_tags(tags, session)).join(waiting.select("uri").distinct(), "uri", "left_semi")
        known = session.read.parquet(_write_batch(wanted, out_dir, "_tags", run, batch_id))

        def results():
            return catalog.results_with_tags(waiting, known, stamp)

        def embeddings():
            work = enrich.embedding_requests(results())
            answers = enrich.score_once(work, lambda context, ep: [tuple(x) for x in embed(context, ep)], "context",
                                        finished("_embedded"), endpoints=endpoints, max_passes=max_passes,
                                        result_type=enrich.EMBEDDING_RESPONSE)
            rows = answers.where("error is null").withColumnRenamed("result", "video_embeddings")
            return sinks.typed(enrich.embedding_rows(rows), S.EMBEDDINGS_TYPED)

        outputs = {
            "results": results,
            "_untagged": lambda: waiting.join(known, "uri", "left_anti"),
            "failures": lambda: described.where(F.col("error").isNotNull()),
            "texts": lambda: sinks.text_beside_source(described, "uri").select(
                F.col("target_name").alias("name"), F.col("description").alias("text")),
        }
        _guarded(outputs | ({"embeddings": embeddings} if embed else {}), session, out_dir, run, batch_id)

    return _start(mp4.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint), available_now)


def current_tags(tags: DataFrame | str | Callable, spark: SparkSession) -> DataFrame:
    """The tags as they are now."""
    if isinstance(tags, str):
        return A.read_tags(spark, tags)
    return tags(spark) if callable(tags) else tags


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def expire_intermediates(spark: SparkSession, out_dir: str, now_ts: str | None = None,
                         max_age_seconds: int = RETENTION_SECONDS, tables: tuple = INTERMEDIATES) -> list[str]:
    """STR-4: remove the stored intermediates of batches older than the retention age.

    The inventory (SRC-5) gives every batch folder its newest file. A run's last batch stays
    whatever its age: it may be written again, and the next batch reads what it left untagged.
    One row per batch folder reaches the driver. Returns the folders removed.
    """
    now = F.lit(now_ts).cast("timestamp") if now_ts else F.current_timestamp()
    gone = []
    for table in tables:
        if not _exists(spark, f"{out_dir}/{table}"):
            continue
        part = F.regexp_extract("path", r"^(.*/run=[^/]+)/batch_id=\d+/", 1)
        batch = F.regexp_extract("path", r"/batch_id=(\d+)/", 1).cast("bigint")
        folders = A.object_inventory(spark, f"{out_dir}/{table}").select(
            part.alias("run"), batch.alias("batch"), "modificationTime").groupBy("run", "batch").agg(
            F.max("modificationTime").alias("written"))
        last = folders.groupBy("run").agg(F.max("batch").alias("last"))
        old = folders.join(last, "run").where(
            (F.col("batch") < F.col("last")) & (F.col("written") < now - F.make_dt_interval(secs=F.lit(max_age_seconds))))
        for r in old.collect():
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{r.run}/batch_id={r.batch}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            gone.append(path.toString())
    return gone


def typed_tags(tags: DataFrame) -> DataFrame:
    """Tags with every column of F3; missing ones are null."""
    return sinks.typed(tags, S.TAGS)
