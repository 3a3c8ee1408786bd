"""Near-duplicate groups: MinHash with tensored banding, links confirmed on full sets.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A document's
set holds its distinct five-word shingles; with fewer words the whole sequence
is its one element. Documents are linked when ``100 * |A & B| >= 75 * |A | B|``.

Method
    1. One pass computes each document's set size, a 128-bit key of its set and
       2 x ``BANDS`` short band hashes (``ROWS`` minima each). Equal sets form one
       class; from here on a class is represented by its smallest id.
    2. Tensored banding: a table key combines one band of the left collection
       with one of the right, so 2 x BANDS bands give BANDS^2 tables. A pair of
       similarity s meets in some table with probability (1-(1-s^ROWS)^BANDS)^2,
       which is 0.9997 at s = 0.75. Bands that no other class shares are left
       out before the combination (they can form no shared key).
    3. In each table key every class is compared with the key's hub (the class
       that shares most bands); a hub's comparisons are split into small chunks.
       That is linear in the rows, also for a key with very many classes.
    4. Keys whose classes are still in several components are finished exactly:
       small keys compare their remaining pairs of different components, the
       classes of larger keys go through a prefix filter (two sets this similar
       share one of their rarest quarter of shingles, at positions that still
       allow the overlap), so a passage that many texts share makes no pairs.
    5. Every candidate is confirmed on the full sets of the whole texts.

Defined cases: null or empty text: empty set, linked with nothing; null doc_id:
own row, component null, kept; several rows of one doc_id are one node, linked
through any of its texts; no rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.llm.common import components, doc_texts, long_lists, map_arrow, stash, utf8

WORDS = 5
ROWS, BANDS = 3, 16
SMALL_KEY = 12   # classes of a table key whose pairs are compared directly
CHUNK = 64       # comparisons with one hub in one group
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = out * _MUL + h[i:len(h) - k + 1 + i]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20260101)
    return (r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1),
            r.integers(0, 1 << 32, n, dtype=np.uint32))


def minima(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over the set, in slices of bounded size."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(mul), np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 2048):
        best = np.minimum(best, (x[None, at:at + 2048] * mul[:, None] + add[:, None]).min(axis=1))
    return best


def bands(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """2 x BANDS band hashes: first the left collection (even), then the right one (odd)."""
    m = minima(s, mul, add).astype(np.uint64).reshape(2 * BANDS, ROWS)
    out = np.arange(1, 2 * BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = (out ^ m[:, i]) * _MUL
        out ^= out >> np.uint64(31)
    return (out & ~np.uint64(1) | (np.arange(2 * BANDS) >= BANDS).astype(np.uint64)).view(np.int64)


def _sketch(batches):
    mul, add = _permutations(2 * BANDS * ROWS)
    for batch in batches:
        sizes, keys, flat, offsets = [], [], [], [0]
        for text in utf8(batch.column(1)):
            s = shingles(text)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            if len(s):
                flat.append(bands(s, mul, add))
            offsets.append(offsets[-1] + (2 * BANDS if len(s) else 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
             long_lists(offsets, np.concatenate(flat) if flat else np.empty(0, np.int64))],
            ["doc_id", "n_shingles", "set_key", "bands"])


def _confirm(batches):
    """Rows come sorted by (hub, part, member flag): a hub's texts, then its members."""
    hub, sets = None, []
    for batch in batches:
        a, part, member, ids = (batch.column(i).to_pylist() for i in range(4))
        left, right = [], []
        for key, m, i, text in zip(zip(a, part), member, ids, utf8(batch.column(4))):
            s = shingles(text)
            if key != hub:
                hub, sets = key, []
            if not m:
                sets.append(s)
                continue
            for t in sets:
                if not len(s) or not 75 * max(len(s), len(t)) <= 100 * min(len(s), len(t)):
                    continue
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= 75 * (len(s) + len(t) - common):
                    left.append(key[0])
                    right.append(i)
                    break
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold on the full sets of their whole texts.

    ``a`` is the hub; its members are dealt to parts of about CHUNK rows, each
    with one copy of the hub's text, so a hub with very many members spreads.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    wanted = (dealt.select("a", "part", F.lit(True).alias("member"), F.col("b").alias("doc_id"))
              .union(dealt.select("a", "part").distinct()
                     .select("a", "part", F.lit(False), F.col("a"))))
    rows = (wanted.join(texts, "doc_id").select("a", "part", "member", "doc_id", "text")
            .repartition("a", "part").sortWithinPartitions("a", "part", "member"))
    return map_arrow(rows, _confirm, "a long, b long").distinct()


def similar_sizes(x: str, y: str):
    return F.expr(f"75 * greatest({x}, {y}) <= 100 * least({x}, {y})")


def table_rows(classes: DataFrame) -> DataFrame:
    """(key, node, n, degree): the table keys of classes that share both of their bands."""
    each = classes.select("node", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    kept = (each.join(shared, "band").groupBy("node")
            .agg(F.collect_list("band").alias("s"), F.sum("c").alias("degree")))  # at most 2 x BANDS
    return (kept.select("node", "degree", F.expr("filter(s, x -> x & 1 = 0)").alias("l"), F.expr("filter(s, x -> x & 1 = 1)").alias("r"))
            .join(classes.select("node", F.col("n_shingles").alias("n")), "node")
            .select("node", "n", "degree", F.explode("l").alias("l"), "r")
            .select("node", "n", "degree", "l", F.explode("r").alias("r"))
            .select(F.xxhash64("l", "r").alias("key"), "node", "n", "degree"))


def _shingle_rows(batches):
    for batch in batches:
        sets = [shingles(t) for t in utf8(batch.column(2))]
        n = [len(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(batch.column(0).to_pylist(), np.int64), n)),
             pa.array(np.repeat(np.array(batch.column(1).to_pylist(), np.int64), n)),
             pa.array(np.repeat(np.array(n, np.int64), n)),
             pa.array((np.concatenate(sets) if sets else np.empty(0, np.uint64)).view(np.int64))],
            ["node", "component", "n", "h"])


def rare_prefix_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that a prefix filter cannot rule out.

    Exact: a total order of shingles by (frequency, hash); sets with the wanted
    similarity share a shingle in the first n - ceil(0.75 n) + 1 of each, and
    from the first shared one enough must be left to reach the overlap.
    """
    rows = stash(map_arrow(nodes.join(texts, nodes.node == texts.doc_id).select("node", "component", "text"),
                           _shingle_rows, "node long, component long, n long, h long"), "shingles")
    often = rows.groupBy("h").agg(F.count("*").alias("df"))
    order = (rows.join(often, "h").groupBy("node", "component", "n")
             .agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s")))  # one document's set
    prefix = stash(order.select("node", "component", "n",
                                F.posexplode(F.expr("slice(s, 1, int(n - ceil(0.75 * n) + 1))")).alias("at", "x"))
                   .where("x.df > 1").select("node", "component", "n", "at", F.col("x.h").alias("h")), "prefix")
    spread = prefix.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    prefix = prefix.join(spread.select("h"), "h")
    x, y = prefix.alias("x"), prefix.alias("y")
    return (x.join(y, F.expr("x.h = y.h and x.node < y.node and x.component <> y.component "
                             "and 75 * greatest(x.n, y.n) <= 100 * least(x.n, y.n) "
                             "and 175 * least(x.n - x.at, y.n - y.at) >= 75 * (x.n + y.n)"))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())


def links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes that connect each group of similar ones."""
    rows = stash(table_rows(classes), "tables")
    keys = (rows.groupBy("key").agg(F.count("*").alias("c"),
                                    F.max(F.struct("degree", (-F.col("node")).alias("hub"), "n")).alias("top"))
            .where("c > 1").select("key", "c", (-F.col("top.hub")).alias("hub"), F.col("top.n").alias("hub_n")))
    near = stash(rows.join(keys, "key").select("key", "node", "n", "c", "hub", "hub_n"), "tables")
    # the texts move once; all comparisons read this smaller table
    texts = stash(texts.join(near.select(F.col("node").alias("doc_id")).distinct(), "doc_id"), "texts")
    first = stash(near.where(F.col("node") != F.col("hub")).where(similar_sizes("n", "hub_n"))
                  .select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    found = stash(confirm(first, texts), "links")
    part = components(found)
    rest = (near.where("c > 2").join(part, near.node == part.id, "left")
            .select("key", "node", "n", "c", F.coalesce("component", "node").alias("component")))
    open_keys = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rest = stash(rest.join(open_keys.select("key"), "key"), "rest")
    small = (rest.where(F.col("c") <= SMALL_KEY).groupBy("key")
             .agg(F.collect_list(F.struct("node", "n", "component")).alias("s"))  # at most SMALL_KEY
             .select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y"))
             .where("x.node < y.node and x.component <> y.component").where(similar_sizes("x.n", "y.n"))
             .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    large = rest.where(F.col("c") > SMALL_KEY).select("node", "component").distinct()
    pairs = small.union(rare_prefix_pairs(large, texts)).distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stash(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    return found.union(confirm(pairs, texts))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    texts = doc_texts(docs)
    sketch = stash(map_arrow(texts, _sketch,
                             "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketch")
    real = sketch.where("doc_id is not null and set_key is not null")
    classes = stash(real.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
                                                F.first("bands").alias("bands")), "classes")
    # an id with several different texts joins the classes of all of them
    several = (real.select("doc_id", "set_key").distinct().join(classes.select("set_key", "node"), "set_key")
               .groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.collect_set("node").alias("b"))
               .where("a < z").select("a", F.explode("b").alias("b")).where("a < b"))
    edges = stash(links(classes, texts).union(several), "links")
    groups = components(edges)
    of_class = (classes.join(groups, classes.node == groups.id, "left")
                .select("set_key", F.coalesce("component", "node").alias("component")))
    return (sketch.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each group; repeated rows of an id go once."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    own = "_row_without_doc_id"
    rest = docs.join(gone, "doc_id", "left_anti").select(
        *docs.columns, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias(own))
    return rest.dropDuplicates(["doc_id", own]).drop(own)
