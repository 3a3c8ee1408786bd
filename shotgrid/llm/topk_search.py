"""Exact top-k inner products of stated queries by norm-bucketed retrieval.

Components become ``floor(256 * x)``, so products are whole numbers and ranks are
exact. Rows are dealt by falling length over ranges and packed into buckets of
``BUCKET`` rows at most, whose longest vector is no more than ``1 / RATIO`` times
the shortest one. The queries form groups of bounded size. Each (group, stripe)
meets the buckets of its stripe in the order of falling length and keeps, for
every query, its best k rows so far; the k-th score is the query's bound.

With bound ``s``, query length ``|q|`` and the bucket's greatest length ``l``, the
bucket's local cosine threshold is ``t = s / (|q| l)``: a row below it cannot
enter. Per query and bucket one of three ways is taken from ``t``:

* ``t > 1``: no row can enter, the bucket is passed over;
* coordinate pruning, from ``t >= COSINE`` on: a unit vector within the angle
  ``arccos t`` of the query has its coordinate c in
  ``[cos(min(pi, a + b)), cos(max(0, a - b))]`` with ``a = arccos q_c`` and
  ``b = arccos t``. The sorted list of the query's most selective large
  coordinate gives the rows in that interval, the next ones thin them out;
* length pruning otherwise, or where the intervals hold more than ``SHARE`` of
  the bucket: rows sorted by length, the prefix with ``|p| >= s / |q|``.

The rows left are verified by whole inner products: in 32- or 64-bit floats where
the lengths prove all sums exact, in Python's integers beyond. What a stripe kept
(k rows a query) is ranked once more over all stripes.

Nothing is collected but three numbers. A group's queries (``GROUP_BYTES``) and a
bucket (``BUCKET_BYTES``) are all a task holds; buckets are copied once for each
group and queries once for each stripe, packed, and groups times stripes stay
near ``spark.sql.shuffle.partitions``. Equal vectors, however many, are dealt over
many ranges by the row number.

Defined cases: vectors that are null, hold null or non-finite components (also
after the factor 256) take no part; a null vec_id is a candidate and ranks after
all others of its score; vectors of different widths are filled up with zeros, an
empty one scores 0; repeated rows and repeated vec_ids are rows of their own, a
query leaves out only its own row and each repeated query gets its own result;
scores beyond a long count as the nearest long; no rows or no queries: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shotgrid.llm.common import bounded_batches, map_arrow, stash

K = 5
EVERY = 50             # rows whose vec_id this divides are queries
FACTOR = 256
BUCKET = 4096          # rows of a bucket at most
BUCKET_BYTES = 4 << 20
GROUP_BYTES = 16 << 20
RATIO = 0.8            # shortest to longest vector of a bucket ...
LEAST = 256            # ... unless it has fewer rows
COSINE = 0.7           # local threshold from which coordinates are tried
FOCUS = 3              # coordinates looked at
SHARE = 0.25           # of a bucket's rows in the interval, beyond which lengths prune
STEP = 256             # queries verified by one product
LOW = np.iinfo(np.int64).min
MARGIN = 1e-9          # relative, on float bounds; always towards keeping a row

PREPARED = "row long, vec_id long, norm double, wide boolean, dims int, data binary"
PACKED = ("stripe int, grp int, kind int, norm double, n int, dims int, wide boolean, "
          "rows binary, ids binary, nulls binary, data binary")
FOUND = "query_row long, query_id long, vec_id long, score long"


def _prepare(batches):
    """Whole-number vectors as bytes: 16-bit numbers where a batch allows it, else doubles."""
    for batch in batches:
        row, vec_id, lists = batch.column(0), batch.column(1), batch.column(2)
        offsets = np.asarray(lists.offsets.to_numpy(), np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
        base, flat = offsets[0], flat[offsets[0]:offsets[-1]]
        offsets = offsets - base
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(flat * FACTOR)
        wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = np.flatnonzero(wrong[offsets[1:]] == wrong[offsets[:-1]])
        sizes = np.diff(offsets)[good]
        keep = np.repeat(wrong[offsets[1:]] == wrong[offsets[:-1]], np.diff(offsets))
        flat = flat[keep]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        wide = bool(len(flat) and np.abs(flat).max() > 32767)
        at = np.repeat(np.arange(len(good)), sizes)
        with np.errstate(over="ignore"):
            top = np.zeros(len(good))
            np.maximum.at(top, at, np.abs(flat))
            scaled = flat / np.maximum(top, 1.0)[at]
            norm = np.sqrt(np.bincount(at, scaled * scaled, len(good))) * np.maximum(top, 1.0)
        data = flat.astype("<f8" if wide else "<i2")
        buffer = pa.py_buffer(np.ascontiguousarray(data).tobytes())
        places = pa.py_buffer((ends * data.itemsize).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [row.take(pa.array(good)), vec_id.take(pa.array(good)), pa.array(norm), pa.array([wide] * len(good), pa.bool_()),
             pa.array(sizes, pa.int32()), pa.Array.from_buffers(pa.binary(), len(good), [None, places, buffer])],
            [f.split()[0] for f in PREPARED.split(", ")])


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, norm, wide, dims, data) of the vectors that take part."""
    rows = (vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                           F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null"))
    return map_arrow(rows, _prepare, PREPARED)


def matrix(parts: list[tuple[bool, int, bytes]]) -> np.ndarray:
    """Vectors (wide, dims, data) below each other, filled up with zeros: 16-bit numbers or doubles."""
    width = max((d for _, d, _ in parts), default=0)
    kind = "<f8" if any(w for w, _, _ in parts) else "<i2"
    if all(d == width and not w for w, d, _ in parts):
        return np.frombuffer(b"".join(x for _, _, x in parts), "<i2").reshape(len(parts), width)
    out = np.zeros((len(parts), width), kind)
    for i, (w, d, x) in enumerate(parts):
        out[i, :d] = np.frombuffer(x, "<f8" if w else "<i2")
    return out


def _pack(kind: int, stripes: int, most: int, most_bytes: int, ratio: float):
    """Rows in the order of falling length -> packed rows; a pack's stripe goes round by partition and number."""
    def run(batches):
        from pyspark import TaskContext
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        names = [f.split()[0] for f in PACKED.split(", ")]

        def packed():
            m = matrix([(w, d, x) for _, _, _, w, d, x in held])
            values = [[(part + number) % stripes], [part], [kind], [held[0][2]], [len(held)], [m.shape[1]],
                      [m.dtype.kind == "f"], [np.array([r[0] for r in held], "<i8").tobytes()],
                      [np.array([r[1] or 0 for r in held], "<i8").tobytes()],
                      [np.array([r[1] is None for r in held], "u1").tobytes()], [m.tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(),
                     pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                full = held and (len(held) >= most or size + 8 * r[4] > most_bytes or
                                 len(held) >= LEAST and r[2] < ratio * held[0][2])
                if full:
                    yield packed()
                    number, held, size = number + 1, [], 0
                held.append(r)
                size += 8 * r[4]
        if held:
            yield packed()
    return run


def exact_products(q: np.ndarray, p: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of whole-number rows; ``bound`` is at least the product of any two lengths."""
    d = min(q.shape[1], p.shape[1])
    q, p = q[:, :d], p[:, :d]
    if bound < 2.0 ** 24:   # by Cauchy-Schwarz every partial sum is a whole number below 2 ** 24
        return (q.astype(np.float32) @ p.astype(np.float32).T).astype(np.int64)
    if bound < 2.0 ** 53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    sums = whole(q) @ whole(p).T if d else np.zeros((len(q), len(p)), object)
    return np.clip(sums, LOW, np.iinfo(np.int64).max).astype(np.int64)


class Bucket:
    """Rows of similar length, longest first, with sorted coordinate lists built when first asked for."""

    def __init__(self, norm: float, rows, ids, nulls, vectors: np.ndarray):
        self.norm, self.rows, self.ids, self.nulls, self.vectors = norm, rows, ids, nulls, vectors
        if vectors.dtype.kind == "f":
            top = np.maximum(np.abs(vectors).max(axis=1, initial=0.0), 1.0)
            self.norms = np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1)) * top
        else:
            v = vectors.astype(np.float64)
            self.norms = np.sqrt((v * v).sum(axis=1))
        self.unit, self.lists = None, {}

    def coordinate(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if self.unit is None:
            self.unit = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        if c not in self.lists:
            order = np.argsort(self.unit[:, c], kind="stable")
            self.lists[c] = order, self.unit[order, c]
        return self.lists[c]


class Queries:
    """A group's queries with their best k rows so far."""

    def __init__(self, rows, ids, vectors: np.ndarray, k: int):
        n = len(rows)
        self.rows, self.ids, self.vectors, self.k = rows, ids, vectors, k
        self.norms = Bucket(0.0, rows, ids, None, vectors).norms
        self.unit = vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.bound = np.full(n, LOW)                       # score of the k-th row so far,
        self.last_id, self.last_null = np.zeros(n, np.int64), np.ones(n, bool)  # and its id
        self.best = np.empty((0, 4), np.int64)             # query, score, null, vec_id
        self.ways = {"passed over": 0, "coordinates": 0, "lengths": 0}

    def meet(self, b: Bucket) -> None:
        reach = self.norms * b.norm
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(reach > 0, self.bound / reach, np.where(self.bound > 0, np.inf, -np.inf)) * (1 - MARGIN) - MARGIN
        alive = t <= 1.0
        self.ways["passed over"] += int((~alive).sum())
        hits = []
        by_length = alive.copy()
        if len(b.rows) >= LEAST:
            for q in np.flatnonzero(alive & (t >= COSINE)):
                rows = self.focus(q, t[q], b)
                if rows is not None:
                    by_length[q] = False
                    hits.append(self.verify(np.array([q]), b, rows))
        self.ways["coordinates"] += int((alive & ~by_length).sum())
        self.ways["lengths"] += int(by_length.sum())
        queries = np.flatnonzero(by_length)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.bound[queries] > 0, self.bound[queries] / self.norms[queries], 0.0) * (1 - MARGIN)
        prefix = np.searchsorted(-b.norms, -need, "right")
        order = np.argsort(prefix, kind="stable")
        for i in range(0, len(order), STEP):
            some = order[i:i + STEP]
            hits.append(self.verify(queries[some], b, np.arange(prefix[some].max())))
        self.keep(hits)

    def focus(self, q: int, t: float, b: Bucket) -> np.ndarray | None:
        """Rows whose coordinates lie where the threshold's cone lets them; None: too many."""
        width = min(self.unit.shape[1], b.vectors.shape[1])
        u = self.unit[q, :width]
        if not width:
            return None
        largest = np.argsort(-np.abs(u), kind="stable")[:FOCUS]
        angle = np.arccos(np.clip(u[largest], -1, 1))
        half = math.acos(min(1.0, max(-1.0, t)))
        lo = np.cos(np.minimum(math.pi, angle + half)) - 1e-6
        hi = np.cos(np.maximum(0.0, angle - half)) + 1e-6
        spans = []
        for c, x, y in zip(largest.tolist(), lo, hi):
            order, values = b.coordinate(c)
            i, j = int(np.searchsorted(values, x, "left")), int(np.searchsorted(values, y, "right"))
            spans.append((j - i, c, order[i:j], x, y))
        spans.sort(key=lambda s: s[0])
        if spans[0][0] > SHARE * len(b.rows):
            return None
        rows = spans[0][2]
        for _, c, _, x, y in spans[1:]:
            v = b.unit[rows, c]
            rows = rows[(v >= x) & (v <= y)]
        return rows

    def verify(self, queries: np.ndarray, b: Bucket, rows: np.ndarray) -> np.ndarray:
        """(query, score, null, vec_id) of the pairs that may enter."""
        if not len(rows) or not len(queries):
            return np.empty((0, 4), np.int64)
        bound = float(self.norms[queries].max() * b.norms[rows].max()) * (1 + MARGIN)
        scores = exact_products(self.vectors[queries], b.vectors[rows], bound)
        least = self.bound[queries]
        fresh = np.flatnonzero(least == LOW)
        k = self.k + 1                                     # its own row may be among them
        if len(fresh) and scores.shape[1] > k:
            least = least.copy()
            least[fresh] = np.partition(scores[fresh], -k, axis=1)[:, -k]
        i, j = np.nonzero(scores >= least[:, None])
        q, at, s = queries[i], rows[j], scores[i, j]
        null, last = b.nulls[at].astype(bool), self.last_null[q]
        sooner = (~null & last) | (null == last) & (b.ids[at] < self.last_id[q])
        good = (self.rows[q] != b.rows[at]) & ((s > self.bound[q]) | sooner | (self.bound[q] == LOW))
        return np.stack([q, s, null, b.ids[at]], axis=1)[good]

    def keep(self, hits: list[np.ndarray]) -> None:
        every = np.concatenate([self.best, *hits])
        order = np.lexsort((every[:, 3], every[:, 2], -every[:, 1].astype(np.float64), every[:, 0])) \
            if np.abs(every[:, 1]).max(initial=0) < 2 ** 53 and LOW not in every[:, 1] else \
            np.lexsort((every[:, 3], every[:, 2], ~every[:, 1], every[:, 0]))
        every = every[order]
        first = np.searchsorted(every[:, 0], every[:, 0], "left")
        place = np.arange(len(every)) - first
        self.best = every[place < self.k]
        last = self.best[(place[place < self.k]) == self.k - 1]
        self.bound[last[:, 0]], self.last_null[last[:, 0]], self.last_id[last[:, 0]] = last[:, 1], last[:, 2], last[:, 3]


def _search(k: int):
    """Rows by (grp, stripe): first the group's queries, then buckets by falling length."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def result(group: Queries) -> pa.RecordBatch:
        q, score, null, vec_id = group.best.T
        return pa.RecordBatch.from_arrays(
            [pa.array(group.rows[q]), pa.array(group.ids[q]), pa.array(vec_id, pa.int64(), mask=null.astype(bool)),
             pa.array(score)], names)

    def run(batches):
        key, packs, group = None, [], None
        for batch in batches:
            for stripe, grp, kind, norm, n, dims, wide, rows, ids, nulls, data in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (grp, stripe):
                    if group is not None:
                        yield result(group)
                    key, packs, group = (grp, stripe), [], None
                rows, ids = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8")
                vectors = np.frombuffer(data, "<f8" if wide else "<i2").reshape(n, dims)
                if kind == 0:
                    packs.append((rows, ids, vectors))
                    continue
                if group is None and packs:
                    width = max(v.shape[1] for _, _, v in packs)
                    filled = [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, _, v in packs]
                    group = Queries(np.concatenate([r for r, _, _ in packs]), np.concatenate([i for _, i, _ in packs]),
                                    np.concatenate(filled), k)
                    packs = []
                if group is not None:
                    group.meet(Bucket(norm, rows, ids, np.frombuffer(nulls, "u1"), vectors))
        if group is not None:
            yield result(group)
    return run


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best other rows, ties to the smaller vec_id.

    ``queries`` is a condition on the column ``vec_id`` that names the query rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = stash(prepared(vectors, id_col, vector_col), "topk")
    asked = rows.where(queries & F.col("vec_id").isNotNull())
    n, width = asked.agg(F.count("*"), F.max("dims")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, math.ceil(n * 8 * (width or 1) / GROUP_BYTES))
    stripes = max(1, math.ceil(partitions / groups))

    def dealt(df, parts, *pack):
        ordered = df.repartitionByRange(parts, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
        return stash(map_arrow(ordered, _pack(*pack), PACKED), "topk")

    each = dealt(asked, groups, 0, 1, BUCKET, BUCKET_BYTES, 0.0)
    buckets = dealt(rows, partitions, 1, stripes, BUCKET, BUCKET_BYTES, RATIO)
    columns = [f.split()[0] for f in PACKED.split(", ")]
    every_stripe = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    met = (each.withColumn("stripe", every_stripe).select(*columns)
           .union(buckets.withColumn("grp", every_group).select(*columns))
           .repartition(groups * stripes, "grp", "stripe").sortWithinPartitions("grp", "stripe", "kind", F.desc("norm")))
    found = map_arrow(met, _search(k), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
