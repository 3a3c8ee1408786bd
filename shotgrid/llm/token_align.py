"""Alignment of two tokenizers' tokens over a corpus, with corpus-wide pair counts.

The byte offsets where a token of each ends cut a text into groups; a link is a
pair of tokens whose byte ranges overlap, so the links are the stretches between
neighbouring token ends of either side. Where both files allow it (``splits``),
texts are taken apart before runs of spaces and line ends, where neither tokenizer
joins and so a group ends; a slice's distinct units are encoded and aligned once,
and a text's numbers are its units' sums. A text with other white space before
such a run is one unit.

Identity-map fast path: ``Vocabularies.same`` gives for every A id the B id with
the same bytes. A group of one A and one B token with ``B = same[A]`` is regular:
a document's regular groups are kept as A ids with numbers, and the corpus counts
them in vectors as long as A's vocabulary, one a task. Only the links of all other
groups enter the pair shuffle, as (pair, number) of a document, summed before and
after it. A pair's count is what both ways found of it.

A document's ``n_best`` and ``count_sum`` need its pairs' corpus counts. Those of
regular pairs and of the heaviest irregular ones go to the tasks as arrays: by the
vocabulary's size and, as a pair counts as heavy only with more than one
``HEAVY``-th of all irregular links, by ``HEAVY`` in number. The other pairs are
joined, which spreads them evenly as no frequent one is left among them.

Defined cases: texts that are null or empty, or whose tokens' bytes do not make up
a space and the text, have no tokens: zeros and an empty ``groups_sha256``;
strings of special tokens are plain text; repeated rows count each; no rows: no
rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.llm.common import doc_texts, map_arrow, stash, utf8

BYTE_FILE = "byte_bpe_50k.json"          # A: encodes space + text
PIECE_FILE = "piece_bpe_32k.model"       # B: adds the space itself
HEAVY = 1 << 16
SLICE = 3 << 20                          # bytes of texts aligned together; a longer text is aligned alone
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
JOINED = re.compile(r"[^\S \n][ \n]")

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
           "same_a array<int>, same_n array<int>, pair array<long>, pair_n array<int>")


def byte_of_letter() -> dict[str, int]:
    """Byte-level letters: printable ones stand for themselves, the others follow from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabularies:
    """Both libraries' encoders and their tokens' bytes; ``same`` is the identity map."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(public_tokenizers.path(byte_file))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_file))
        letters, vocabulary = byte_of_letter(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        piece, is_byte = self.b.id_to_piece, self.b.is_byte
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if is_byte(i) else piece(i).replace("▁", " ").encode()
                        for i in range(self.b.vocab_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        plain = [i for i in range(len(self.b_bytes)) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        first = {}
        for i in sorted(plain, key=lambda i: (is_byte(i), i)):      # ordinary pieces before byte pieces
            first.setdefault(self.b_bytes[i], i)
        self.same = np.array([first.get(x, -1) for x in self.a_bytes], np.int64)
        text = lambda n, end: np.array([f"{i}{end}".encode() for i in range(n)], object)
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.a_inner, self.a_last, self.b_inner, self.b_last = text(n, ","), text(n, "|"), text(m, ","), text(m, ";")
        self.splits = self._splits()

    def _splits(self) -> bool:
        """Do both files prove that no token reaches over the start of a run of spaces or line ends?

        A: byte level by its usual pattern, where white space never follows another
        character in a word. B: no piece has a space or a line end behind another character.
        """
        config = json.loads(self.a.to_str())
        words = config["pre_tokenizer"] or {}
        usual = words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space")
        pieces = [self.b_bytes[i] for i in range(len(self.b_bytes)) if not self.b.is_byte(i)]
        apart = not any(re.search(rb"[^ ] |\n", x) for x in pieces)
        return bool(usual and config["normalizer"] is None and apart and self.b.encode("\n")[0] == self.b.piece_to_id("▁"))

    def code(self, a, b):
        """A pair as one number."""
        return a * np.int64(len(self.b_bytes)) + b


@lru_cache(maxsize=2)
def vocabularies(byte_file: str, piece_file: str) -> Vocabularies:
    return Vocabularies(byte_file, piece_file)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def units_of(text: str, splits: bool) -> list[str]:
    """A space and the text, taken apart; none for an empty text."""
    if not text:
        return []
    whole = " " + text
    # other white space before a run joins with it in A
    return UNIT.findall(whole) if splits and not JOINED.search(whole) else [whole]


class Aligned:
    """Groups and links of some distinct units."""

    def __init__(self, v: Vocabularies, units: list[str]):
        n = len(units)
        data = [u.encode() for u in units]
        a, a_n = flat([e.ids for e in v.a.encode_batch_fast(units, add_special_tokens=False)])
        # B puts a space in front, but of nothing: the unit's own, or one to be dropped
        space = [v.b.piece_to_id("▁")]
        b, b_n = flat([space if u == " " else x if u[0] == " " else x[1:] for u, x in zip(
            units, v.b.encode([u[u[0] == " ":] for u in units], num_threads=1))])
        wanted = np.array([len(x) for x in data], np.int64)
        good = (_sums(v.a_size[a], a_n) == wanted) & (_sums(v.b_size[b], b_n) == wanted)
        a, b = a[np.repeat(good, a_n)], b[np.repeat(good, b_n)]
        a_n, b_n, wanted = np.where(good, a_n, 0), np.where(good, b_n, 0), np.where(good, wanted, 0)
        a_spelt, b_spelt = (b"".join(map(t.__getitem__, x.tolist())) for t, x in ((v.a_bytes, a), (v.b_bytes, b)))
        whole = b"".join(x for x, ok in zip(data, good.tolist()) if ok)
        spelt = good.copy()
        if a_spelt != whole or b_spelt != whole:                              # some unit is not spelt by its tokens
            at = (np.cumsum(wanted) - wanted).tolist()
            for k in np.flatnonzero(good).tolist():
                spelt[k] = a_spelt[at[k]:at[k] + len(data[k])] == data[k] == b_spelt[at[k]:at[k] + len(data[k])]
        self.good = spelt
        # ends on one axis through all units: a unit's end is an end of both sides
        a_end, b_end, ends = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b]), np.cumsum(wanted)
        both = a_end[np.isin(a_end, b_end, assume_unique=True, kind="sort")]
        stops = np.sort(np.concatenate([a_end, np.setdiff1d(b_end, both, assume_unique=True)]))
        i, j = np.searchsorted(a_end, stops), np.searchsorted(b_end, stops)
        one = (a_end[i] == b_end[j]) & (v.a_size[a[i]] == v.b_size[b[j]])     # one A and one B token
        regular = one & (v.same[a[i]] == b[j])
        unit = np.searchsorted(ends, stops)
        self.sizes = np.stack([a_n, b_n, np.bincount(np.searchsorted(ends, both), minlength=n),
                               np.bincount(unit, minlength=n)], axis=1)
        self.same = _ordered(unit[regular], a[i[regular]], n)
        self.pair = _ordered(unit[~regular], v.code(a[i[~regular]], b[j[~regular]]), n)
        # groups as text: per group the A ids, then the B ids
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        a_text = np.where(both[a_group] == a_end, v.a_last[a], v.a_inner[a])
        b_text = np.where(both[b_group] == b_end, v.b_last[b], v.b_inner[b])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        pieces = np.concatenate([a_text, b_text])[order].tolist()
        last = np.cumsum(a_n + b_n).tolist()
        self.texts = [b"".join(pieces[x:y])[:-1] for x, y in zip([0, *last], last)]


def _ordered(unit: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of n units, and their values (``unit`` rises)."""
    return np.searchsorted(unit, np.arange(n + 1)), value


def _added(rows: np.ndarray, units: np.ndarray, times: np.ndarray, lists, n: int):
    """Per row (offsets, distinct values, how often) of its units' values."""
    offsets, values = lists
    size = offsets[units + 1] - offsets[units]
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(offsets[units], size)
    row, value, times = np.repeat(rows, size), values[place], np.repeat(times, size)
    order = np.lexsort((value, row))
    row, value, times = row[order], value[order], times[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(times, first) if len(first) else times
    return np.searchsorted(row[first], np.arange(n + 1)), value[first], total


class _Numbers(dict):
    """New keys get the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def align(v: Vocabularies, texts: list[bytes], with_groups: bool = False) -> dict[str, pa.Array]:
    """The columns of ``ALIGNED`` from ``n_a`` on, for some whole texts."""
    n, numbers = len(texts), _Numbers()
    found, sizes = flat([list(map(numbers.__getitem__, units_of(t.decode(), v.splits))) for t in texts])
    aligned = Aligned(v, list(numbers))
    bad = _sums((~aligned.good[found]).astype(np.int64), sizes) > 0           # not spelt by its tokens
    at = np.cumsum(sizes) - sizes
    found_list = found.tolist()
    groups = [b"" if no or not size else b";".join([aligned.texts[u] for u in found_list[x:x + size]])
              for no, x, size in zip(bad.tolist(), at.tolist(), sizes.tolist())]
    row = np.repeat(np.arange(n), np.where(bad, 0, sizes))
    found = found[np.repeat(~bad, sizes)]
    counts = np.stack([np.bincount(row, aligned.sizes[found, c], n) for c in range(4)], axis=1).astype(np.int64)
    key, times = np.unique(row * np.int64(max(len(numbers), 1)) + found, return_counts=True)
    rows, units = np.divmod(key, np.int64(max(len(numbers), 1)))
    same = _added(rows, units, times, aligned.same, n)
    pair = _added(rows, units, times, aligned.pair, n)

    def lists(offsets, values, kind):
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    return {"n_a": pa.array(counts[:, 0]), "n_b": pa.array(counts[:, 1]), "n_groups": pa.array(counts[:, 2]),
            "n_links": pa.array(counts[:, 3]),
            "groups": pa.array([g.decode() for g in groups] if with_groups else [None] * n, pa.string()),
            "groups_sha256": pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string()),
            "same_a": lists(same[0], same[1], pa.int32()), "same_n": lists(same[0], same[2], pa.int32()),
            "pair": lists(pair[0], pair[1], pa.int64()), "pair_n": lists(pair[0], pair[2], pa.int32())}


def _align(byte_file: str, piece_file: str, with_groups: bool):
    names = [f.split()[0] for f in ALIGNED.split(", ")]

    def run(batches):
        v = vocabularies(byte_file, piece_file)
        for batch in batches:
            texts = utf8(batch.column(2))
            first = size = 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= SLICE or k + 1 == len(texts):
                    out = align(v, texts[first:k + 1], with_groups)
                    out |= {"row": batch.column(0)[first:k + 1], "doc_id": batch.column(1)[first:k + 1]}
                    yield pa.RecordBatch.from_arrays([out[c] for c in names], names)
                    first, size = k + 1, 0
    return run


def alignments(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE,
               with_groups: bool = True) -> DataFrame:
    """``ALIGNED``: per row its groups as text, its regular A ids and its irregular pairs with their numbers."""
    rows = doc_texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return map_arrow(rows, _align(byte_file, piece_file, with_groups), ALIGNED)


def _regular(size: int):
    """Sums a task's regular groups in one vector of A's vocabulary."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            a, n = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            total += np.bincount(a, n, size).astype(np.int64)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(total[a])], ["a", "n"])
    return run


def pair_counts(aligned: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """(pair, total, irregular, best): every linked pair's corpus-wide counts; ``best`` is its B id's highest one."""
    spark = aligned.sparkSession
    v = vocabularies(byte_file, piece_file)
    same = spark.createDataFrame([(i, int(v.code(i, b))) for i, b in enumerate(v.same.tolist()) if b >= 0],
                                 "a long, pair long")                       # as long as the vocabulary
    regular = (map_arrow(aligned.select("same_a", "same_n"), _regular(len(v.a_bytes)), "a long, n long")
               .join(F.broadcast(same), "a").select("pair", "n", F.lit(0).cast("long").alias("irregular")))
    other = (aligned.select(F.explode(F.arrays_zip("pair", "pair_n")).alias("x"))
             .select("x.pair", F.col("x.pair_n").cast("long").alias("n"), F.col("x.pair_n").cast("long").alias("irregular")))
    counts = stash(regular.union(other).groupBy("pair").agg(F.sum("n").alias("total"), F.sum("irregular").alias("irregular")),
                   "pairs")
    b = F.col("pair") % len(v.b_bytes)
    top = counts.groupBy(b.alias("b")).agg(F.max("total").alias("top"))     # as long as B's vocabulary
    return counts.join(F.broadcast(top), b == F.col("b")).select("pair", "total", "irregular", (F.col("total") == F.col("top")).alias("best"))


def _weigh(known: tuple[np.ndarray, np.ndarray, np.ndarray], size_b: int, byte_file: str, piece_file: str):
    """Adds up the counts of regular and of heavy pairs, which all tasks know."""
    codes, totals, best = known

    def run(batches):
        v = vocabularies(byte_file, piece_file)
        own = np.where(v.same >= 0, v.code(np.arange(len(v.same)), v.same), -1)
        at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
        found = codes[at] == own if len(codes) else np.zeros(len(own), bool)
        a_total = np.where(found, totals[at], 0) if len(codes) else np.zeros(len(own), np.int64)
        a_best = np.where(found, best[at], False) if len(codes) else np.zeros(len(own), bool)
        for batch in batches:
            a, a_n, pair, pair_n = batch.columns[1:]
            sizes = np.diff(a.offsets.to_numpy()), np.diff(pair.offsets.to_numpy())
            a, a_n, pair, pair_n = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, a_n, pair, pair_n))
            if len(codes):
                at = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
                hit = codes[at] == pair
                p_sum, p_best = np.where(hit, totals[at] * pair_n, 0), np.where(hit & best[at], pair_n, 0)
            else:
                p_sum = p_best = np.zeros(len(pair), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_sums(a_best[a] * a_n, sizes[0]) + _sums(p_best, sizes[1])),
                 pa.array(_sums(a_total[a] * a_n, sizes[0]) + _sums(p_sum, sizes[1]))], ["row", "n_best", "count_sum"])
    return run


def align_corpus(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE,
                 heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row."""
    aligned = stash(alignments(docs, byte_file, piece_file, with_groups=False), "aligned")
    counts = stash(pair_counts(aligned, byte_file, piece_file), "pairs")
    v = vocabularies(byte_file, piece_file)
    size_b = len(v.b_bytes)
    same = docs.sparkSession.createDataFrame(
        [(int(v.code(i, b)),) for i, b in enumerate(v.same.tolist()) if b >= 0], "pair long")
    links = counts.agg(F.sum("irregular")).first()[0] or 0
    # at most ``heavy`` pairs can hold more than one heavy-th of all links
    heavy_pairs = counts.where(F.col("irregular") * heavy > links)
    known = (counts.join(F.broadcast(same), "pair", "left_semi").union(heavy_pairs).distinct()
             .select("pair", "total", "best").toPandas().sort_values("pair"))
    arrays = (known["pair"].to_numpy(np.int64), known["total"].to_numpy(np.int64), known["best"].to_numpy(bool))
    sums = map_arrow(aligned.select("row", "same_a", "same_n", "pair", "pair_n"),
                     _weigh(arrays, size_b, byte_file, piece_file), "row long, n_best long, count_sum long")
    codes = F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in arrays[0].tolist()], "pair long"))
    light = (aligned.select("row", F.explode(F.arrays_zip("pair", "pair_n")).alias("x"))
             .select("row", "x.pair", F.col("x.pair_n").cast("long").alias("n")).join(codes, "pair", "left_anti")
             .join(counts, "pair").groupBy("row")
             .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum")))
    weights = sums.union(light).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(weights, "row")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
