"""Catalogue of described chunks: tags join, viewer queries, pending work,
annotation request manifest (JN-1, JN-2, JN-9, AGG-6, FLT-7/8, PRJ-1, SRT-1,
LIM-1/2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.functions.scalars import (base_name, format_ts, language_code, prompt_text,
                                        request_output_uri)


def results_with_tags(outputs: DataFrame, tags: DataFrame, run_ts: str) -> DataFrame:
    """JN-1: a model result is kept only when its object carries tags.

    ``run_ts`` is taken once per run and stamped on every row (SCL-10).
    """
    stamp = format_ts(F.lit(run_ts).cast("timestamp"))
    return outputs.join(tags, "uri", "inner").select(
        "index", "time_start", "time_stop", "video_blobname", "video_source", "description",
        stamp.alias("update_time"), "uri")


def movie_list(results: DataFrame) -> DataFrame:
    """AGG-6: distinct video names."""
    return results.select("video_blobname").distinct()


def movie_description(results: DataFrame, video: str) -> DataFrame:
    """FLT-7 + PRJ-1 + SRT-1: one video's descriptions in numeric index order.

    The name is bound as a literal (never spliced into SQL text); null and
    exactly-``ERROR`` descriptions drop, ``ERROR: ...`` rows stay.
    """
    if "MODEL_MULTIMODAL" not in results.columns:
        results = results.withColumn("MODEL_MULTIMODAL", F.lit(None).cast("string"))
    return results.where((F.col("video_blobname") == F.lit(video))
                         & (F.col("description") != F.lit("ERROR"))) \
        .select(F.col("index"), F.col("time_start").alias("start"),
                F.col("time_stop").alias("stop"), "description", "uri",
                F.col("MODEL_MULTIMODAL").alias("llm_model")) \
        .orderBy(F.col("index").cast("bigint"))


def top_rows(df: DataFrame, n: int = 20) -> DataFrame:
    """LIM-2: first ``n`` rows of an ordered frame (TakeOrderedAndProject)."""
    return df.limit(max(0, int(n)))


def pending_only(work: DataFrame, done: DataFrame, key: str = "uri") -> DataFrame:
    """JN-9: rows whose output does not exist yet (left anti join)."""
    return work.join(done.select(key), key, "left_anti")


def prompts(results: DataFrame) -> DataFrame:
    """PRJ-7: image prompt text per described chunk."""
    return results.select("uri", prompt_text(F.col("description")).alias("prompt"))


# The features requested unless a caller names others: the pipeline's active list.
ACTIVE_FEATURES = ["SHOT_CHANGE_DETECTION"]


def request_manifest(videos: DataFrame, bucket: str, stamp: str,
                     features: list[str] | None = None, split: bool = True) -> DataFrame:
    """JN-2 + SCL-5/7/12: annotation requests for videos (``input_uri``: ``gs://...``).

    ``split``: one request per video x feature, the feature in the output path (a
    literal array exploded per row, not a join). Otherwise one request per video
    for all features, without a feature in its path.
    """
    wanted = features or ACTIVE_FEATURES
    v = videos.select("input_uri", base_name(F.col("input_uri")).alias("file_system"),
                      language_code(F.col("input_uri")).alias("language_code"))
    if not split:
        return v.select(
            "input_uri", F.array(*[F.lit(f) for f in wanted]).alias("features"), "language_code", "file_system",
            F.concat(F.lit(f"gs://{bucket}/"), F.col("language_code"), F.lit("/"), F.col("file_system"),
                     F.lit(f" - {stamp}.json")).alias("output_uri"))
    return v.select("*", F.explode(F.array(*[F.lit(f) for f in wanted])).alias("feature")).select(
        "input_uri", "feature", "language_code", "file_system",
        request_output_uri(F.lit(bucket), F.col("language_code"), F.col("feature"),
                           F.col("file_system"), F.lit(stamp)).alias("output_uri"))
