"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits in lower case. An overlap counts when
``MIN_OVERLAP`` neighbouring words of an item (or the whole item, if shorter)
stand in the document with at least ``MIN_EQUAL`` equal words at equal places.

A seed is a fixed mask over such a window; the positions it leaves out may hold
any word. If k words may differ, the window is cut into k + 2 blocks and the
masks are all pairs of blocks: k replaced words spoil at most k blocks, so one
mask always keeps its hash and no overlap is missed. The hashes of all masks at
all positions of all items are joined with those of every position of every
document; a hit fixes an alignment, along which the words are compared.

The benchmark is joined in blocks of at most ``BLOCK_WORDS`` words, the proven
bound of what is broadcast; a larger benchmark takes more passes over the
documents, and never a shuffle of them. Hot seeds cost nothing: both sides of a
hit meet in the task that read the document.

Defined cases: null or empty texts are clean; items without words, or with
fewer than ``MIN_ITEM`` of them, cannot be told from chance and match nothing;
repeated items and rows are treated alike; an item without an id contaminates
like any other, in one row of ``leaks`` with a null item_id, and is not listed
among ``items``; empty ``documents`` give no rows, other columns are not read; a null doc_id is matched like any
other, its row carries its own verdict; no items: every document is clean.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.llm.common import map_arrow

MIN_OVERLAP = 13
MIN_EQUAL = 0.8
MIN_ITEM = 4
BLOCK_WORDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def needed(n: int) -> int:
    """Equal words that a window of ``n`` words must hold."""
    return -int(-MIN_EQUAL * n // 1)


def seed_hashes(h: np.ndarray, n: int) -> list[np.ndarray]:
    """For each mask over ``n`` words: its hash at every position of ``h`` where it fits."""
    size, k = len(h) - n + 1, n - needed(n) + 2
    if size <= 0:
        return []
    edges = [i * n // k for i in range(k + 1)]
    blocks = []
    for a, b in zip(edges, edges[1:]):
        out = np.full(size, np.uint64(1 + len(blocks) + 64 * n))
        for i in range(a, b):
            out = (out ^ h[i:size + i]) * _MUL
            out ^= out >> np.uint64(32)
        blocks.append(out)
    pairs = [(x * _MUL ^ y) * _MUL for x, y in combinations(blocks, 2)]
    return [p ^ p >> np.uint64(29) for p in pairs]


@dataclass
class Block:
    """Seeds of some benchmark items, sorted by hash, with a bitmap to skip most lookups."""

    ids: list              # item id of each item, None where it has none
    words: np.ndarray      # word hashes of all items, one after another
    starts: np.ndarray     # where each item starts, and the end
    windows: list[int]     # lengths of the windows: MIN_OVERLAP and those of shorter items
    seeds: np.ndarray      # sorted
    item: np.ndarray       # item of each seed
    at: np.ndarray         # position of each seed in its item
    bits: np.ndarray       # bitmap over the upper bits of the hashes
    shift: np.uint64


def build_block(items: list[tuple[int, np.ndarray]]) -> Block:
    items = [(i, h) for i, h in items if len(h) >= MIN_ITEM]
    seeds, item, at = [], [], []
    for k, (_, h) in enumerate(items):
        for s in seed_hashes(h, min(MIN_OVERLAP, len(h))):
            seeds.append(s)
            item.append(np.full(len(s), k))
            at.append(np.arange(len(s)))
    windows = sorted({min(MIN_OVERLAP, len(h)) for _, h in items})
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    seeds, item, at = cat(seeds, np.uint64), cat(item, np.int64), cat(at, np.int64)
    order = np.argsort(seeds, kind="stable")
    width = max(16, min(24, int(len(seeds)).bit_length() + 8))
    shift = np.uint64(64 - width)
    bits = np.zeros(1 << width, bool)
    bits[(seeds >> shift).astype(np.int64)] = True
    words = [h for _, h in items]
    return Block([i for i, _ in items], cat(words, np.uint64),
                 np.cumsum([0, *map(len, words)]), windows, seeds[order], item[order], at[order], bits, shift)


def overlaps(block: Block, h: np.ndarray) -> list[tuple[int | None, int, int, int]]:
    """(item id, first word, words, equal words) of the best window of each verified alignment."""
    found = set()
    for s in (s for n in block.windows for s in seed_hashes(h, n)):
        pos = np.flatnonzero(block.bits[(s >> block.shift).astype(np.int64)])
        if not len(pos):
            continue
        lo = np.searchsorted(block.seeds, s[pos], "left")
        hi = np.searchsorted(block.seeds, s[pos], "right")
        for p, a, b in zip(pos[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
            found.update(zip(block.item[a:b].tolist(), (p - block.at[a:b]).tolist()))
    out = []
    for k, shift in sorted(found):  # document position = item position + shift
        words = block.words[block.starts[k]:block.starts[k + 1]]
        first, last = max(0, shift), min(len(h), shift + len(words))
        need = min(MIN_OVERLAP, len(words))
        if last - first < need:
            continue
        equal = np.cumsum(np.concatenate([[0], h[first:last] == words[first - shift:last - shift]]))
        window = equal[need:] - equal[:-need]
        best = int(window.argmax())
        if window[best] >= needed(need):
            out.append((block.ids[k], first + best, need, int(window[best])))
    return out


def blocks(benchmark: DataFrame):
    """The benchmark's items in blocks of at most BLOCK_WORDS words (and one item more)."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        held.append((r.item_id, word_hashes(r.text)))
        size += len(held[-1][1])
        if size >= BLOCK_WORDS:
            yield build_block(held)
            held, size = [], 0
    if held:
        yield build_block(held)


def _find(shared):
    def run(batches):
        block = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best = {}
                for item, *window in overlaps(block, word_hashes(text or "")) if len(block.seeds) else ():
                    if item not in best or window[-1] > best[item][-1]:
                        best[item] = window
                rows += [(doc_id, item, *w) for item, w in best.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)],
                ["doc_id", "item_id", "first_word", "n_words", "n_equal"])
    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_equal): the best verified overlap of each pair."""
    sc, out = docs.sparkSession.sparkContext, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in blocks(benchmark):
        part = map_arrow(rows, _find(sc.broadcast(block)),
                         "doc_id long, item_id long, first_word long, n_words long, n_equal long")
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, first_word long, n_words long, n_equal long")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, kept, items, n_equal), one row per distinct doc_id.

    ``items`` are the ids of the benchmark items found, in order; ``n_equal`` is
    the best overlap's number of equal words.
    """
    found = (leaks(docs, benchmark).groupBy(F.col("doc_id").alias("found_id"))
             .agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("n_equal").alias("n_equal")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return (ids.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
            .select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.col("items").isNull().alias("kept"),
                    F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
                    F.coalesce("n_equal", F.lit(0)).alias("n_equal")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no verified overlap: one pass per block, no shuffle."""
    sc = docs.sparkSession.sparkContext
    for block in blocks(benchmark):
        docs = map_arrow(docs, _keep_clean(sc.broadcast(block)), docs.schema)
    return docs


def _keep_clean(shared):
    def run(batches):
        block = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            clean = [not (len(block.seeds) and overlaps(block, word_hashes(t or ""))) for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))
    return run
