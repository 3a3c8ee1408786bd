"""Typed and untyped sinks (SNK-1..6).

Writes go through Spark's file commit protocol: a failed task is retried and
only committed files become visible, which replaces the reference's
per-call retry loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid import schema as S
from shotgrid.functions.scalars import replace_extension


def as_text(df: DataFrame, null_as: str | None = None) -> DataFrame:
    """SNK-1 cast: every column to STRING; ``null_as`` replaces nulls if given."""
    cols = []
    for c in df.columns:
        v = F.col(c).cast("string")
        if null_as is not None:
            v = F.coalesce(v, F.lit(null_as))
        cols.append(v.alias(c))
    return df.select(*cols)


def save_text(df: DataFrame, path: str, mode: str = "append", null_as: str | None = None,
              partition_by: list[str] | None = None) -> None:
    """SNK-1: append with every column as text. Writing an empty frame is a no-op."""
    w = as_text(df, null_as).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def typed(df: DataFrame, ddl: str) -> DataFrame:
    """Cast to a declared schema (missing columns become typed nulls)."""
    from pyspark.sql import types as T
    schema = T.StructType.fromDDL(ddl)
    cols = []
    for f in schema.fields:
        v = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(v.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def save_embeddings(df: DataFrame, path: str, truncate: bool = False) -> None:
    """SNK-2: embeddings with the declared schema; append or truncate."""
    typed(df, S.EMBEDDINGS_TYPED).write.mode("overwrite" if truncate else "append").parquet(path)


def save_results_typed(df: DataFrame, path: str, truncate: bool = False) -> None:
    """SNK-3: results with the declared schema; append or truncate."""
    typed(df, S.RESULTS_TYPED).write.mode("overwrite" if truncate else "append").parquet(path)


def text_beside_source(df: DataFrame, name_col: str, new_extension: str = ".json") -> DataFrame:
    """SNK-4: target object name = source name with its extension replaced."""
    return df.withColumn("target_name", replace_extension(F.col(name_col), new_extension))


def write_texts(df: DataFrame, path: str, name_col: str = "target_name", text_col: str = "text",
                mode: str = "append") -> None:
    """SNK-4: one (name, text) row per result, partitioned storage."""
    df.select(F.col(name_col).alias("name"), F.col(text_col).alias("text")) \
        .write.mode(mode).parquet(path)


def write_manifest(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-5: chunk manifest table (object name + tags); video bytes are not cut here."""
    chunks.write.mode(mode).parquet(path)


def to_client(df: DataFrame, n: int = 20):
    """SNK-6: bounded transfer to the client."""
    return df.limit(n).toPandas()
