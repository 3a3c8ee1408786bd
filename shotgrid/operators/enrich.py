"""Batch scoring with failover (UDF-1..7), embeddings rows (NST-16), JSON
overlay (NST-17/18).

The model call is a caller-supplied Python callable; hosted models are not part
of this library. ``score`` runs it with ``mapInPandas`` (Arrow batches), tries
endpoints in order, retries retryable errors for up to ``max_passes`` passes
and records the outcome per row instead of dropping failures.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shotgrid.functions.scalars import clean_json, context_text
from shotgrid.session import bounded_batches

ERROR_PREFIX = "ERROR: "
# What an embedding call answers: its segments with their vectors.
EMBEDDING_RESPONSE = "array<struct<start_offset_sec:double,end_offset_sec:double,embedding:array<double>>>"


LEDGER_GROUP = 64   # outcomes of ``score_once`` in one file of its ledger


class Retryable(Exception):
    """Raised by a scoring function for errors worth another pass (quota, ...)."""


def clean_text(text: str) -> str:
    """SCL-8 on a Python string: fences and the word json out, single quotes double."""
    for token in ("json", "JSON", "```"):
        text = text.replace(token, "")
    return text.replace("'", '"')


def _answer(out):
    """A model's answer: streamed parts are joined, text is cleaned (UDF-3, UDF-4)."""
    if isinstance(out, Iterator):
        out = list(out)
        if all(isinstance(x, str) for x in out):
            out = "".join(out)
    return clean_text(out) if isinstance(out, str) else out


def _call_with_failover(fn, value, endpoints, max_passes, is_retryable, pause, options, longest=60.0):
    """(result, error, attempts, endpoint) of one value.

    Endpoints are tried in order; the outcome of the last one tried decides
    whether another pass follows (an ``ERROR`` answer or a retryable error: yes).
    Passes wait a random time that may grow exponentially up to ``longest``.
    """
    attempts, message = 0, ""
    for turn in range(max_passes):
        again = False
        for ep in endpoints:
            attempts += 1
            try:
                out = _answer(fn(value, ep, **options))
            except Exception as e:  # noqa: BLE001 - recorded per row
                message, again = str(e), is_retryable(e)
                continue
            if not (isinstance(out, str) and out == "ERROR"):
                return out, None, attempts, ep
            again = True
        if not again:
            break
        if pause and turn + 1 < max_passes:
            time.sleep(random.uniform(min(pause, longest), min(pause * 2 ** turn, longest)))
    return ERROR_PREFIX + message, message, attempts, None


def score(df: DataFrame, fn: Callable, input_col: str, endpoints: Sequence[str] = ("default",),
          max_passes: int = 3, is_retryable: Callable[[Exception], bool] | None = None,
          pause_seconds: float = 0.0, result_type: str = "string", partitions: int | None = None,
          **options) -> DataFrame:
    """Apply ``fn(value, endpoint, **options)`` to every row of ``input_col``.

    Adds ``result`` (``result_type``; text is cleaned), ``error``, ``attempts``,
    ``endpoint``. A failure's text result is ``ERROR: <message>``. ``pause_seconds``
    is the least wait between passes.
    ``partitions`` sets the scoring parallelism (a repartition before the map).
    """
    retry = is_retryable or (lambda e: isinstance(e, Retryable))
    eps = list(endpoints)
    out_fields = [T.StructField("result", T.DataType.fromDDL(result_type)),
                  T.StructField("error", T.StringType()),
                  T.StructField("attempts", T.IntegerType()),
                  T.StructField("endpoint", T.StringType())]
    schema = T.StructType(df.schema.fields + out_fields)
    string_result = result_type.lower() == "string"

    def run(batches):
        for pdf in batches:
            res = [_call_with_failover(fn, v, eps, max_passes, retry, pause_seconds, options)
                   for v in pdf[input_col].tolist()]
            out = pdf.copy()
            out["result"] = [r[0] if (string_result or r[1] is None) else None for r in res]
            out["error"] = [r[1] for r in res]
            out["attempts"] = pd.array([r[2] for r in res], dtype="int32")
            out["endpoint"] = [r[3] for r in res]
            yield out

    src = df.repartition(partitions) if partitions else df
    bounded_batches(df.sparkSession)
    return src.mapInPandas(run, schema)


def _ledger_writer(call: Callable, result: pa.DataType, folder: str, turn: str, group: int):
    """A map over (key, value) rows that calls the model and files every ``group`` outcomes before it goes on.

    A group's file is named after the turn and its keys, so that a task run anew finds what it has filed and
    calls nothing twice; a file appears whole (written aside, then moved).
    """
    def run(batches):
        schema = pa.schema([("key", pa.string()), ("result", result), ("error", pa.string()),
                            ("attempts", pa.int32()), ("endpoint", pa.string())])
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        rows = (r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        while part := list(itertools.islice(rows, group)):
            name = f"{turn}-" + hashlib.sha256("".join(k for k, _ in part).encode()).hexdigest()
            target = f"{root}/{name}.parquet"
            if fs.get_file_info(target).type == pafs.FileType.NotFound:
                got = [call(v) for _, v in part]
                results = [r[0] if r[1] is None or result == pa.string() else None for r in got]
                columns = [[k for k, _ in part], results, *([r[i] for r in got] for i in (1, 2, 3))]
                table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                aside = f"{root}/.{name}-{uuid.uuid4().hex}"
                pq.write_table(table, aside, filesystem=fs)
                fs.move(aside, target)
            yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32())], ["n"])

    return run


def score_once(df: DataFrame, fn: Callable, input_col: str, ledger: str, endpoints: Sequence[str] = ("default",),
               max_passes: int = 3, is_retryable: Callable[[Exception], bool] | None = None,
               pause_seconds: float = 0.0, result_type: str = "string", partitions: int | None = None,
               group: int = LEDGER_GROUP, **options) -> DataFrame:
    """``score`` with a ledger of finished calls under the folder ``ledger``, which driver and executors share.

    Outcomes are filed by ``group`` as they come, under the SHA-256 of their inputs. Whoever runs the same input again (a task whose executor was
    lost, a job that was stopped, a replayed batch) calls the model only for what is not filed: at most one
    unfinished group a task is called twice. Equal inputs are called once. Inputs with a filed success are left
    out by an anti join; failures of an earlier run are tried again, and their success then counts. Inputs are
    text; a null one is not called and fails with ``no input``. Adds the columns of ``score``; ``df`` is read twice.
    """
    spark = df.sparkSession
    retry, eps = is_retryable or (lambda e: isinstance(e, Retryable)), list(endpoints)
    filed_schema = f"key string, result {result_type}, error string, attempts int, endpoint string"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(ledger).getFileSystem(spark._jsc.hadoopConfiguration())
    folder = re.sub(r"^file:/+", "file:///", fs.makeQualified(path(ledger)).toString()).replace("s3a://", "s3://")

    def call(value):
        return _call_with_failover(fn, value, eps, max_passes, retry, pause_seconds, options)

    def filed() -> DataFrame:
        if not fs.exists(path(ledger)) or not len(fs.globStatus(path(ledger, "*.parquet"))):
            return spark.createDataFrame([], filed_schema)
        return spark.read.schema(filed_schema).parquet(ledger)

    done = filed().where("error is null").select("key").distinct()
    todo = df.select(F.sha2(input_col, 256).alias("key"), F.col(input_col).alias("value")).where("key is not null") \
        .join(done, "key", "left_anti").dropDuplicates(["key"])
    # a task run anew sees its inputs in the same order, so in the same groups
    dealt = (todo.repartition(partitions, "key") if partitions else todo).sortWithinPartitions("key")
    bounded_batches(spark)
    writer = _ledger_writer(call, to_arrow_type(T.DataType.fromDDL(result_type)), folder, uuid.uuid4().hex, group)
    dealt.mapInArrow(writer, "n int").write.format("noop").mode("overwrite").save()

    outcome = F.struct("result", "error", "attempts", "endpoint")
    best = filed().groupBy(F.col("key").alias("_ledger_key")).agg(
        F.min_by(outcome, F.struct(F.col("error").isNotNull(), "attempts")).alias("_ledger"))
    none = F.lit(ERROR_PREFIX + "no input") if result_type.lower() == "string" else F.lit(None)
    called = F.col("_ledger_key").isNotNull()
    return df.join(best, F.sha2(input_col, 256) == F.col("_ledger_key"), "left").select(
        *df.columns, F.when(called, F.col("_ledger.result")).otherwise(none).alias("result"),
        F.when(called, F.col("_ledger.error")).otherwise("no input").alias("error"),
        F.coalesce("_ledger.attempts", F.lit(0)).alias("attempts"), F.col("_ledger.endpoint").alias("endpoint"))


def clean_answer(df: DataFrame, col: str = "result", ddl: str | None = None) -> DataFrame:
    """UDF-3 tail: clean the model text (SCL-8) and optionally parse it."""
    cleaned = clean_json(F.col(col))
    out = df.withColumn("clean", cleaned)
    if ddl:
        out = out.withColumn("parsed", F.from_json("clean", ddl))
    return out


def embedding_requests(chunks: DataFrame, description_col: str = "description") -> DataFrame:
    """SCL-9 before embedding: the context text sent with each chunk."""
    return chunks.withColumn("context", context_text(F.col(description_col)))


def embedding_inputs(df: DataFrame, text_col: str | None = "text",
                     image_col: str | None = "image_uri", strict: bool = True) -> DataFrame:
    """UDF-6 precondition: an embedding request needs a text, an image, or both.

    ``strict`` raises on a row with neither (as the reference does); otherwise
    such rows are filtered out.
    """
    have = []
    for c in (text_col, image_col):
        if c and c in df.columns:
            have.append(F.col(c).isNotNull())
    if not have:
        raise ValueError("at least one of text_col / image_col must be a column")
    ok = have[0] if len(have) == 1 else have[0] | have[1]
    if strict:
        return df.withColumn("_ok", F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.lit("embedding request needs a text or an image")))) \
            .where(F.col("_ok")).drop("_ok")
    return df.where(ok)


def embedding_rows(responses: DataFrame) -> DataFrame:
    """NST-16: one row per video segment of an embedding response.

    ``responses`` has video_source, description, index and ``video_embeddings``
    (ARRAY<STRUCT<start_offset_sec, end_offset_sec, embedding>>). Output is the
    typed embeddings table shape (SNK-2).
    """
    e = responses.select("video_source", "description", "index",
                         F.explode("video_embeddings").alias("v"))
    return e.select("video_source", "description",
                    F.col("v.embedding").cast("array<double>").alias("embeddings"),
                    F.col("index").cast("int").alias("index"),
                    F.col("v.start_offset_sec").cast("double").alias("start"),
                    F.col("v.end_offset_sec").cast("double").alias("stop"))


def json_props(df: DataFrame, col: str, ddl: str, keep: Sequence[str] = ()) -> DataFrame:
    """NST-18: a JSON object per row -> its fields as columns."""
    return df.select(*keep, F.from_json(F.col(col), ddl).alias("j")).select(*keep, "j.*")


MODELS = {}


def register_model(name: str, fn: Callable, **options) -> None:
    """UDF-2: a model by name, with the options its calls take."""
    MODELS[name] = (fn, options)


def score_by_name(df: DataFrame, model: str, input_col: str, ledger: str | None = None, **kwargs) -> DataFrame:
    """UDF-2: ``score`` (``score_once``, if a ledger is given) with the model and options registered under ``model``."""
    if model not in MODELS:
        raise ValueError(f"no model named {model!r}; registered: {sorted(MODELS)}")
    fn, options = MODELS[model]
    if ledger:
        return score_once(df, fn, input_col, ledger, **(options | kwargs))
    return score(df, fn, input_col, **(options | kwargs))


def json_overlay(df: DataFrame, json_col: str, tags_col: str, keep: Sequence[str] = (),
                 inner_key: str | None = None) -> DataFrame:
    """NST-17: fields of a JSON record (or of its ``inner_key`` record) overlaid by tags.

    Keys present in the tags win. Done with ``map_filter`` + ``map_concat`` so no
    duplicate-key policy is needed.
    """
    parsed = F.from_json(F.col(json_col), "MAP<STRING, STRING>")
    if inner_key:
        parsed = F.from_json(parsed[inner_key], "MAP<STRING, STRING>")
    tags = F.col(tags_col)
    base = F.map_filter(parsed, lambda k, v: ~F.array_contains(F.map_keys(tags), k))
    return df.select(*keep, F.map_concat(base, tags).alias("props"))
