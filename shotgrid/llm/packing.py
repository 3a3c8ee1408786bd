"""Packing of whole documents into sequences of at most 4096 tokens.

Order-preserving dynamic programming: the documents of a partition form one
stream of tokens; sequences are windows of it. A window may end at a document's
end (free), at a sentence's end (``SENTENCE_CUT``) or, where neither comes
within ``HARD_STEP`` tokens, anywhere (``HARD_CUT``); the rest of a sequence is
padding. With ``f`` the least cost up to a boundary at position p,

    f(j) = penalty(j) + SEQUENCE + LENGTH - p_j + min over p_j - p_i <= LENGTH of f(i) + p_i

and as the window only moves on, its minimum is the head of a monotone queue:
one pass, whatever LENGTH is. The stream is solved in blocks of ``BLOCK``
tokens; less than a window at a block's end is left to the next block, so memory
does not grow with a partition. What is left at the partition's end is padded or
cut into powers of two, which need no padding, whichever costs less.

There is no shuffle: a partition of the input is packed by the task that reads
it, so a sequence number depends on how the input is split, and a repeated task
packs the same rows in the same way.

Defined cases: null or empty text: one token, the end mark; null doc_id: its
pieces carry null; a text longer than a sequence lies in several pieces;
repeated rows are packed each; no rows: no pieces.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shotgrid.llm import tokens
from shotgrid.llm.common import doc_texts, map_arrow, utf8

LENGTH = 4096
END = 2                 # id after each document
SENTENCE_CUT = 2.0      # penalties in tokens of padding
HARD_CUT = 8.0
SEQUENCE = 1.0
HARD_STEP = 32
BLOCK = 64 * LENGTH
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def plan(positions: np.ndarray, penalties: np.ndarray, length: int = LENGTH, rest=None) -> list[int]:
    """The boundaries (indexes) that end the windows of a cheapest cover of the stream.

    ``positions`` are the boundaries in order, from 0 to the stream's end; no two
    neighbours are further apart than ``length``. With ``rest``, fewer than
    ``length`` tokens at the end may stay uncovered at the cost ``rest(tokens)``.
    """
    reach = np.searchsorted(positions, positions - length).tolist()    # first boundary of a window that ends here
    steps = (penalties + SEQUENCE + length).tolist()
    least, back = [0.0], [0]                    # f + position, and where the window begins
    queue, costs, head = [0], [0.0], 0          # indexes and their f + position: both rising from head on
    for j in range(1, len(steps)):
        low = reach[j]
        while queue[head] < low:
            head += 1
        back.append(queue[head])
        cost = costs[head] + steps[j]
        least.append(cost)
        while costs[-1] >= cost:                # ends at head at the latest: a step costs more than nothing
            queue.pop()
            costs.pop()
        queue.append(j)
        costs.append(cost)
    j = len(steps) - 1
    if rest is not None:
        p = positions.tolist()
        j = min(range(bisect_right(p, p[-1] - length), j + 1), key=lambda i: least[i] - p[i] + rest(p[-1] - p[i]))
    out = []
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def boundaries(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray,
               step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, from 0 and at most ``step`` apart, with their penalties."""
    cost = np.full(len(ids) + 1, np.inf)            # of every position; inf: no boundary
    cost[np.flatnonzero(sentence[ids]) + 1] = SENTENCE_CUT
    cost[ends] = cost[0] = 0.0
    at = np.flatnonzero(cost < np.inf)
    more = (np.diff(at) - 1) // step                # cuts needed between neighbours
    gap = np.repeat(np.arange(len(more)), more)
    place = np.arange(len(gap)) - np.repeat(np.cumsum(more) - more, more) + 1
    cost[at[gap] + place * step] = HARD_CUT
    every = np.flatnonzero(cost < np.inf)
    return every, cost[every]


def tail(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the last sequences for ``n`` tokens: padded, or powers of two, whichever costs less."""
    powers = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return powers if _cost(powers, length) < _cost([n], length) else [n] * (n > 0)


def _cost(sizes: list[int], length: int) -> float:
    pads = sum(0 if n & (n - 1) == 0 else length - n for n in sizes)
    return len(sizes) * SEQUENCE + max(len(sizes) - 1, 0) * HARD_CUT + pads


@lru_cache(maxsize=2)
def sentence_ends(vocabulary: str) -> np.ndarray:
    """Which ids end a sentence: words of stops, maybe with closing marks."""
    library = tokens.codec(vocabulary).library
    vocab = library.get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    for word, i in vocab.items():
        out[i] = bool(re.fullmatch(r"[.!?]+[\"')\]]*(</w>)?", word))
    return out


class Packer:
    """Packs a stream of documents; ``pieces`` collects the rows of finished sequences."""

    def __init__(self, first_sequence: int, sentence: np.ndarray, length: int = LENGTH):
        self.sequence, self.sentence, self.length = first_sequence, sentence, length
        self.docs: deque = deque()     # [doc_id, ids, tokens already placed]
        self.waiting = 0               # tokens not yet placed
        self.pieces: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0])
        self.waiting += len(ids)
        while self.waiting >= BLOCK:
            self.solve(final=False)

    def solve(self, final: bool) -> None:
        parts, ends, n = [], [], 0
        for _, ids, done in self.docs:  # at most BLOCK tokens and the open end of a document
            part = ids[done:done + BLOCK - n]
            parts.append(part)
            n += len(part)
            if done + len(part) == len(ids):
                ends.append(n)
            if n >= BLOCK:
                break
        stream = np.concatenate(parts)
        if not ends or ends[-1] != n:
            ends.append(n)  # the open end of a document
        at, pen = boundaries(stream, np.array(ends, np.int64), self.sentence, min(HARD_STEP, self.length))
        later = (lambda r: _cost(tail(r, self.length), self.length)) if final else (lambda r: r / self.length)
        cuts = at[plan(at, pen, self.length, later)].tolist()
        if final:
            done = cuts[-1] if cuts else 0
            cuts += (done + np.cumsum(tail(n - done, self.length), dtype=np.int64)).tolist()
        for size in np.diff([0, *cuts]).tolist():
            self.place(size)

    def place(self, size: int) -> None:
        offset = 0
        while offset < size:
            doc = self.docs[0]
            doc_id, ids, done = doc
            take = min(size - offset, len(ids) - done)
            crc = zlib.crc32(np.ascontiguousarray(ids[done:done + take], "<u4").tobytes())
            self.pieces.append((doc_id, done, take, crc, len(ids), self.sequence, offset))
            offset += take
            doc[2] += take
            if doc[2] == len(ids):
                self.docs.popleft()
        self.waiting -= size
        self.sequence += 1

    def finish(self) -> None:
        while self.waiting:
            self.solve(final=self.waiting <= BLOCK)


def _pack(vocabulary: str, length: int):
    def run(batches):
        packer = Packer(TaskContext.get().partitionId() << 32, sentence_ends(vocabulary), length)
        names = [f.split()[0] for f in PIECES.split(", ")]

        def taken():
            rows, packer.pieces = packer.pieces, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.ids_bytes_of(vocabulary, utf8(batch.column(1)))):
                packer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(END)))
            yield taken()
        packer.finish()
        yield taken()
    return run


def pack(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    return map_arrow(doc_texts(docs), _pack(vocabulary, length), PIECES)
