"""Rendezvous hashing of stable record keys over weighted shards (DataFrame functions only).

Every (key, shard) pair has a hash u in (0, 1); a record goes to the shard of
least ``-ln(u) / weight``. So a shard gets records in proportion to its weight,
a key's shard depends on nothing but the key and the shards, and a further
shard takes records only into itself.

Slots number the rows of a shard from 0 without gaps: rows are dealt by ranges
of (shard, key, place in the input), counted by shard and range, and numbered inside each range
from the sum of the counts before it; no task sees a whole shard, and only the
small columns move, never the texts.

Defined cases: null text: size 8, the crc of no bytes; null keys share one shard;
repeated rows get one shard and a slot each; no rows: no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shotgrid.llm.common import stash

SHARDS = 24
OVERHEAD = 8  # bytes of a record besides its text


def cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight of a key's string on a shard; the least cost wins."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f":{shard}"))), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(cost, shard) of a key's shard; equal costs go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    return F.array_min(F.array(*(F.struct(cost(key, i, w).alias("cost"), F.lit(i).alias("shard"))
                                 for i, w in enumerate(weights))))


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    ``grown_shard`` is the shard with one more shard of ``new_weight``.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    extra = len(weights)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
                        rendezvous(key, weights).alias("best"), cost(key, extra, new_weight).alias("extra"))
            .select("doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"),
                    F.when(F.col("extra") < F.col("best.cost"), extra).otherwise(F.col("best.shard")).alias("grown_shard")))
    rows = stash(rows, "shards")
    order = ["doc_id", "text_crc32", "size"]
    # equal rows too are dealt over many ranges
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    dealt = stash(salted.repartitionByRange("shard", *order, "salt").withColumn("range", F.spark_partition_id()), "shards")
    counts = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))  # shards x ranges rows at most
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "range").orderBy(*order, "salt")
    return (dealt.withColumn("place", F.row_number().over(inside)).join(offsets, ["shard", "range"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard"))
