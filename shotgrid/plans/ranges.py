"""Range joins: ``probe.t`` inside ``[start, end]`` per key, linear in both inputs.

An equi-join on the video alone followed by a range filter would pair every
probe of a video with every interval of that video. Instead both sides get a
time bucket whose width is a power of two of seconds: an interval uses the
smallest width that holds its length, so it lies in at most two buckets however
long it is, and a probe is bucketed once for each width that occurs among the
intervals of its own key. The join key is ``(keys..., level, bucket)``, so a hot
video spreads over many join keys. No statistics are needed: nothing runs while
the plan is built, and one very long interval adds one level to its own key and
changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, LEVEL, LEVELS = "_bucket", "_level", "_levels"
LOWEST, HIGHEST = -20, 62  # widths from about a microsecond to longer than any video


def level_of(length: Column) -> Column:
    """The smallest n with length <= 2**n (bounded, so that a key has few levels)."""
    n = F.ceil(F.log2(F.greatest(length, F.lit(2.0 ** LOWEST)))).cast("int")
    return F.least(F.greatest(n, F.lit(LOWEST)), F.lit(HIGHEST))


def bucket_of(t: Column, level: Column) -> Column:
    return F.floor(t / F.pow(F.lit(2.0), level)).cast("bigint")


def bucketed(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals with their level and the buckets they touch (two, or three by rounding)."""
    rows = intervals.where(F.col(start) <= F.col(end)) \
        .withColumn(LEVEL, level_of(F.col(end) - F.col(start)))
    return rows.withColumn(BUCKET, F.explode(F.sequence(bucket_of(F.col(start), F.col(LEVEL)),
                                                        bucket_of(F.col(end), F.col(LEVEL)))))


def range_join(probes: DataFrame, intervals: DataFrame, keys: list[str], t: str,
               start: str, end: str, how: str = "inner", end_inclusive: bool = True,
               closed: str | None = None, spread: bool = False) -> DataFrame:
    """Join ``probes`` (keys..., t, ...) to ``intervals`` (keys..., start, end, ...).

    ``end_inclusive`` says whether an interval holds its end; ``closed`` names a
    boolean interval column that says so row by row. With ``how="left"`` a probe
    without a hit keeps its row with nulls. Interval columns other than the keys
    must not clash with probe columns. Empty intervals never match. ``spread`` deals the
    probes anew before each is copied for the widths: of a few bytes, they would else be
    copied in a few tasks, by the million.
    """
    levels = intervals.where(F.col(start) <= F.col(end)).groupBy(*keys).agg(
        F.collect_set(level_of(F.col(end) - F.col(start))).alias(LEVELS))  # HIGHEST - LOWEST + 1 at most
    wanted = probes if how == "inner" else probes.select(*keys, t).distinct()
    pb = wanted.join(levels, keys)
    pb = (pb.repartition(*keys, t) if spread else pb).withColumn(LEVEL, F.explode(LEVELS)).drop(LEVELS)
    pb = pb.withColumn(BUCKET, bucket_of(F.col(t), F.col(LEVEL)))
    after = F.col(t) <= F.col(end) if end_inclusive else F.col(t) < F.col(end)
    if closed is not None:
        after = (F.col(t) < F.col(end)) | (F.col(closed) & (F.col(t) == F.col(end)))
    hits = pb.join(bucketed(intervals, start, end), [*keys, LEVEL, BUCKET]) \
        .where((F.col(t) >= F.col(start)) & after).drop(LEVEL, BUCKET)
    return hits if how == "inner" else probes.join(hits, [*keys, t], "left")
