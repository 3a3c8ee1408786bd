"""The registered queries of this subpackage: one ``opN_<name>`` each, and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shotgrid.llm import (
    decontaminate, host_rules, html_extract, merkle, near_dedup, oracle, packing, secret_scan, sharding, token_align, tokens,
    topk_search, toxicity, url_filter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.toxicity(docs, model).withColumn("held_out", toxicity.held_out())


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark, sf_dir):
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op7_host_rules(spark, sf_dir):
    return (host_rules.judge(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", F.col("failed").alias("rules_failed"), "kept"))


def op8_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op9_rendezvous_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("score")


def op11_topk_search(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % topk_search.EVERY == 0)


def op12_token_alignment(spark, sf_dir):
    return token_align.align_corpus(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.verified(merkle.prove(table(spark, sf_dir, "documents")))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_toxicity, op2_packing, op3_minhash_dedup, op4_decontamination, op5_token_counts, op6_html_extraction,
        op7_host_rules, op8_secret_scan, op9_rendezvous_sharding, op10_url_filter, op11_topk_search, op12_token_alignment, op13_merkle_manifest, pipeline)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
