"""The corpus pipeline: five stages over ``documents``, each on all its predecessor kept.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and returns a DataFrame. All but the last return the columns of ``documents``.
``run`` writes each stage's result to the folder in ``spark.checkpoint.dir``
and reads it as the next one's input.

1. toxicity: documents the lexicon model rejects go;
2. near duplicates: one document of each group stays;
3. benchmark decontamination: documents with a verified overlap go;
4. secrets: the values of found secrets are replaced in the texts;
5. packing: what is left is packed into sequences, one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shotgrid.llm import decontaminate, near_dedup, packing, secret_scan, toxicity
from shotgrid.llm.common import stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels.where(~toxicity.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs, secret_scan.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("packing", pack)]

# The trained models, the components and the packing have no SQL form; tests/llm/test_pipeline.py
# checks the rows against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
