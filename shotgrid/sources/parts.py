"""Long videos in several rows: a stored layout of shots cut by time (SRC-1).

A part is a row (file, part, n_parts, annotation_results) of a document's shape:
each result holds its uri, consecutive shots of it and, in ``base``, the place of
the first of them. A result that holds shots in any part holds a list in all of
them. Operators work on parts row by row and pass only small summaries from part
to part, so no row grows with a video; a file of one part is a whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid import schema as S
from shotgrid.operators.flatten import result_field
from shotgrid.plans.numbering import numbered, same

PART = 1_000  # shots of a part
SHOT_RESULT = f"STRUCT<input_uri: STRING, base: BIGINT, shot_annotations: ARRAY<{S.SHOT}>>"


def shot_parts(docs: DataFrame, size: int = PART) -> DataFrame:
    """The shots of annotation documents as parts; row-local."""
    uris, shots = result_field("input_uri"), result_field("shot_annotations")
    longest = F.aggregate(shots, F.lit(1), lambda n, s: F.greatest(n, F.coalesce(F.size(s), F.lit(1))))
    n = F.ceil(longest / size).cast("int")

    def part(k):
        return F.zip_with("_u", "_s", lambda u, s: F.struct(
            u.alias("input_uri"), (k * size).cast("bigint").alias("base"),
            F.slice(s, k * size + 1, size).alias("shot_annotations")))

    rows = docs.select("file", uris.alias("_u"), shots.alias("_s"), n.alias("n_parts")).where(F.size("_u") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.col("n_parts") - 1), part)
    return rows.select("file", "n_parts", F.posexplode(parts).alias("part", "annotation_results")).select(
        "file", F.col("part").cast("bigint").alias("part"), F.col("n_parts").cast("bigint").alias("n_parts"),
        F.col("annotation_results").cast(f"ARRAY<{SHOT_RESULT}>").alias("annotation_results"))


def result_rows(parts: DataFrame) -> DataFrame:
    """(file, part, result_pos, input_uri, base, items): one row per part and result that holds shots."""
    r = parts.select("file", "part", F.posexplode("annotation_results").alias("result_pos", "r"))
    return r.where(F.size("r.shot_annotations") > 0).select(
        "file", "part", "result_pos", "r.input_uri", "r.base", F.col("r.shot_annotations").alias("items"))


def cut_points(points: DataFrame, keys: list[str], order: list[str], value: str, size: int | None = PART) -> DataFrame:
    """Rows in time order -> (keys..., part, values, next): ``size`` values a part (None: all in one).

    ``next`` is the first value of the next part, null for the last one. Rows are numbered by
    ranges and counts; only the values of one part ever meet in a task.
    """
    placed = numbered(points.select(*keys, *dict.fromkeys([*order, value])), keys, order)
    part = F.floor(F.col("pos") / size).cast("bigint") if size else F.lit(0).cast("bigint")
    parts = placed.groupBy(*keys, part.alias("part")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("values"))
    first = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("part") - 1).alias("_p"),
                         F.element_at("values", 1).alias("next"))
    names = {k: f"_k{i}" for i, k in enumerate(keys)} | {"part": "_p"}
    return parts.join(first, same(parts, first, names), "left").drop(*names.values())
