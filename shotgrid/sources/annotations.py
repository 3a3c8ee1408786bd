"""Annotation JSON, arrival events, object tags and object inventory
(SRC-1..6, FLT-1, FLT-10, STR-4 batch form)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid import schema as S

CORRUPT = "_corrupt"

# Content types accepted by the JSON trigger.
JSON_TYPES = ["application/octet-stream", "text/json", "application/json"]


@dataclass
class Scan:
    """A split read: good documents and quarantined records."""
    good: DataFrame
    quarantine: DataFrame


def split_corrupt(raw: DataFrame) -> Scan:
    """FLT-10 + quarantine: a document is valid only if it parses whole and has ``annotation_results``.

    Both sides read ``annotation_results`` beside the corrupt column (Spark
    refuses a query on the latter alone), so nothing needs to be cached.
    """
    has = F.col("annotation_results").isNotNull()
    good = raw.where(F.col(CORRUPT).isNull() & has).drop(CORRUPT)
    quarantine = raw.where(F.col(CORRUPT).isNotNull() | ~has).select("file", F.col(CORRUPT).alias("record"))
    return Scan(good, quarantine)


def read_annotations(spark: SparkSession, path: str | list[str], features: list[str] | None = None,
                     multi_line: bool = True) -> Scan:
    """SRC-1: read annotation JSON (one object per file, or JSON lines).

    ``features`` narrows the read schema to the features a job needs (JSON has
    no column pruning of its own). Parse errors never fail the job: the record
    goes to quarantine.
    """
    schema = S.reduced_schema(features) if features else S.annotation_schema(CORRUPT)
    raw = (spark.read.schema(schema)
           .option("multiLine", multi_line)
           .option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT)
           .json(path)
           .select(F.col("_metadata.file_path").alias("file"), "*"))
    return split_corrupt(raw)


def parse_annotations(texts: DataFrame, text_col: str = "value", file_col: str = "file",
                      features: list[str] | None = None) -> Scan:
    """SRC-1 on JSON text already in a column (same parser, same rules).

    ``features`` narrows the parse schema like ``read_annotations`` does.
    """
    schema = S.reduced_schema(features) if features else S.annotation_schema(CORRUPT)
    parsed = F.from_json(F.col(text_col), schema.simpleString(),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    raw = texts.select(F.col(file_col).alias("file"), parsed.alias("j"), F.col(text_col).alias("t"))
    whole = F.col(f"j.{CORRUPT}").isNull() & F.col("j.annotation_results").isNotNull()
    raw = raw.select("file", F.col("j.annotation_results").alias("annotation_results"),
                     F.when(~F.coalesce(whole, F.lit(False)), F.col("t")).alias(CORRUPT))
    return Scan(raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT),
                raw.where(F.col(CORRUPT).isNotNull()).select("file", F.col(CORRUPT).alias("record")))


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: arrival event records (F2) from JSON files; keep bucket, name, type."""
    return spark.read.schema(S.ARRIVAL).json(path)


def route(arrivals: DataFrame) -> DataFrame:
    """FLT-1: route column per arrival.

    ``video``: mp4 type and ``.mp4`` in the name; ``json``: one of three JSON
    types; ``audio``: mp3 type; else ``unsupported``.
    """
    ct, name = F.col("contentType"), F.col("name")
    r = (F.when((ct == "video/mp4") & name.contains(".mp4"), F.lit("video"))
         .when(ct.isin(*JSON_TYPES), F.lit("json"))
         .when(ct == "audio/mp3", F.lit("audio"))
         .otherwise(F.lit("unsupported")))
    return arrivals.withColumn("route", r)


def retained(objects: DataFrame, now_ts: str, time_col: str = "timeCreated",
             max_age_seconds: int = 86400) -> DataFrame:
    """STR-4 batch form: objects younger than the retention age at ``now_ts``."""
    cutoff = F.lit(now_ts).cast("timestamp") - F.make_dt_interval(secs=F.lit(max_age_seconds))
    return objects.where(F.col(time_col).cast("timestamp") >= cutoff)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: tag table (F3), one row per tagged object."""
    return spark.read.parquet(path)


def object_inventory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC-5/6: listing of stored objects (path, length, modificationTime).

    ``content`` is never selected, so the bytes are not read.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")
