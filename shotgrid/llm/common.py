"""Helpers shared by the training-data operators.

Conventions all operators keep:

* only the columns an operator needs are read, by name, so further columns
  (also ones named like its own outputs) do no harm;
* a null text counts as an empty one, a null ``doc_id`` is an ordinary row that
  is linked with nothing;
* intermediate tables that are read more than once are written once to the
  folder named in ``spark.checkpoint.dir``, so a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrid.session import shared_dir

BATCH_BYTES = 16 << 20  # of one Arrow batch handed to a Python worker


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, whatever the length of the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) != f"{BATCH_BYTES}b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage).

    The folder is removed when the application ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def doc_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def long_lists(offsets, flat) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def changed_rows(df: DataFrame, condition) -> bool:
    return df.where(condition).limit(1).count() > 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b).

    Minimum labels spread to neighbours and are then replaced by their own
    label (pointer jumping), so long chains need a number of rounds near the
    logarithm of their length. Each round is written to the shared folder;
    minima are taken before the shuffle, so a hub costs no more than a leaf.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component"))
                   .withColumnRenamed("a", "id"), "labels")
    while True:
        seen = (both.join(labels, both.b == labels.id).select(both.a.alias("id"), "component")
                .groupBy("id").agg(F.min("component").alias("near")))
        step = labels.join(seen, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("upper"))
        step = stash(step.join(up, "component").select(
            "id", F.least("component", "upper").alias("component"), "old"), "labels")
        if not changed_rows(step, "component <> old"):
            return step.select("id", "component")
        labels = step.select("id", "component")
