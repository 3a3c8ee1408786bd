"""Places and running maxima inside a key, without a window over all rows of a key.

``numbered`` deals rows by ranges of (key, order), counts them by key and range
and adds up the counts, so a hot key is numbered by as many tasks as it has
ranges. ``max_before`` is a running maximum over the buckets of a key by a tree:
maxima of 2 ** FAN neighbouring buckets are one bucket of the next level, and a
bucket's answer is the maximum of what stands before it inside its group and of
its group's own answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotgrid.session import store

FAN = 12     # bits of a level
LEVELS = 2   # levels above the buckets; what is left at the top is one row per 2 ** 24 buckets


def same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of ``left``'s keys with differently named columns of ``right``."""
    on = F.lit(True)
    for a, b in keys.items():
        on = on & left[a].eqNullSafe(right[b])
    return on


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """``rows`` with their place (from 0) among the rows of their keys; equal rows are numbered apart."""
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    by = [*keys, *order, "_salt"]
    dealt = store(salted.repartitionByRange(*by).sortWithinPartitions(*by)
                  .withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id())
                  .drop("_salt"), "numbered")
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
                          (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    names = {k: f"_k{i}" for i, k in enumerate(keys)} | {"_range": "_r"}
    return (dealt.join(shift, same(dealt, shift, names)).withColumn(name, F.col("_at") + F.col("_shift"))
            .drop("_at", "_range", "_shift", *names.values()))


def max_before(rows: DataFrame, keys: list[str], bucket: str, value: str, name: str,
               fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(keys..., bucket, name): the maximum of ``value`` over all smaller buckets of the key; null if none.

    ``rows`` hold one row per key and (whole-number) bucket.
    """
    tree = [rows.select(*keys, F.col(bucket).alias("_b"), F.col(value).alias("_v"))]
    for _ in range(levels):
        tree.append(tree[-1].groupBy(*keys, F.shiftright("_b", fan).alias("_b")).agg(F.max("_v").alias("_v")))
    whole = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    answer = tree[-1].select(*keys, "_b", F.max("_v").over(whole).alias("_before"))
    for level in reversed(tree[:-1]):
        group = Window.partitionBy(*keys, "_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        own = level.withColumn("_g", F.shiftright("_b", fan)).withColumn("_own", F.max("_v").over(group))
        above = answer.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_up"),
                              F.col("_before").alias("_carry"))
        names = {k: f"_k{i}" for i, k in enumerate(keys)} | {"_g": "_up"}
        answer = own.join(above, same(own, above, names)).select(
            *keys, "_b", F.greatest("_own", "_carry").alias("_before"))
    return answer.select(*keys, F.col("_b").alias(bucket), F.col("_before").alias(name))
