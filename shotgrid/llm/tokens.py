"""Token counts, and ids, of whole texts as the public tokenizers' libraries give them.

Texts up to ``HUGE`` bytes are encoded whole. Longer ones by overlap
resynchronisation: overlapping chunks are encoded with offsets and spliced at a
common boundary that is proven stable - a white space between two characters
that are not, or the end of a run of letters where the pre-tokenizer ends a word,
away from both chunk edges by ``GUARD``, at which both chunks start a token and up
to which they agree on the tokens of the overlap. Where there is none, the overlap
is widened over the next candidates; a chunk without any is doubled, so that the
work stays in proportion to the text.

The vocabulary of words (``tokenizers`` files whose pre-tokenizer drops white
space) can be encoded word by word, as no token and no normalisation reaches
across ASCII white space. ``WordIds`` finds the pre-tokenizer's pieces of some
texts at once and remembers them; new ones go through the library (its model, or
all of it for words with rarer characters).

Defined cases: null counts as empty: no tokens; strings of special tokens in a
text are handled as the library does by default; no truncation or padding;
repeated rows count each; no rows: no rows; further columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.llm.common import doc_texts, map_arrow, utf8

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
HUGE = 1 << 16        # bytes beyond which a text is cut into chunks
CHUNK = 1 << 15       # characters of a chunk
OVERLAP = 1 << 10     # characters two chunks share at first
GUARD = 32            # characters near a chunk's edge that are not trusted
MEMO = 1 << 19        # pieces a worker remembers
MEMO_BYTES = 64 << 20  # and their bytes
SLICE = 8 << 20       # bytes of texts taken apart at once

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class JsonCodec:
    """A ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        words = self.library.to_str()
        self.boundaries = RUNS if r"\\p{L}]+" in words or '"use_regex":true' in words else SPACED

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and first and last offsets in characters."""
        e = self.library.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return np.array(e.ids, np.uint32), at[:, 0], at[:, 1]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class PieceCodec:
    """A ``sentencepiece`` file."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.boundaries = SPACED

    def encode(self, text: str):
        pieces = self.library.encode(text, return_type="proto").pieces  # offsets in bytes
        at = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # first byte of each character
        return (np.array([x.id for x in pieces], np.uint32),
                np.searchsorted(at, np.array([x.begin for x in pieces], np.int64), "right") - 1,
                np.searchsorted(at, np.array([x.end for x in pieces], np.int64), "left"))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), np.uint32)


class WordIds:
    """Ids of texts from their distinct pieces, apart from the library's per-text work.

    The pieces the pre-tokenizer makes of some texts are found from the kinds of
    their characters, all at once; a word with rarer characters or a special
    string is one piece, as it stands. Arrow numbers them together with the
    remembered ones, new ones go through the library (its model, or all of it
    for rarer words), and a text's ids are gathered by number.

    Pieces are remembered in two generations: when the younger one is full, it
    becomes the older one together with what was used of the latter since.
    """

    def __init__(self, codec: JsonCodec):
        config = json.loads(codec.library.to_str())
        self.codec, self.model = codec, codec.library.model
        self.special = tuple(t["content"].encode() for t in config["added_tokens"])
        self.letters = str.maketrans({b: letter for b, letter in _byte_letters().items() if b != 10})
        self.old = self.young = pa.array([], pa.binary())
        self.used = np.zeros(0, bool)                  # which of the older ones, since they became so
        self.ids = np.zeros(0, np.uint32)              # of all pieces remembered, in any order
        self.begins = self.sizes = np.zeros(0, np.int32)    # of each piece's ids there

    def split(self, text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of a text between line feeds, where each starts, and which are rarer words."""
        raw = np.frombuffer(text, np.uint8)
        kinds, low = KINDS[raw], LOWER[raw]
        lead = np.flatnonzero(raw > 0xC1)              # first bytes of longer characters
        code = (raw[lead].astype(np.int16) - 0xC0 << 6) + (raw[lead + 1] & 63)
        kind = LONG_KINDS[code]
        for k in (0, 1):
            kinds[lead + k], low[lead + k] = kind, LONG_LOWER[code, k]
        rare = [lead[kind == RARE], *(np.array([m.start() for m in re.finditer(re.escape(s), text)], np.int64)
                                      for s in self.special if s in text)]
        if sum(map(len, rare)):
            gaps = np.flatnonzero(GAPS[raw])
            after = np.unique(np.searchsorted(gaps, np.concatenate(rare)))
            edge = np.zeros(len(raw), np.int8)
            edge[gaps[after - 1] + 1] = 1
            edge[gaps[after]] = -1
            inside = np.cumsum(edge, dtype=np.int8).view(bool)
            kinds[inside], low[inside] = RARE, raw[inside]
        first = np.ones(len(raw), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
        first |= kinds == NUMBER
        first[lead[kinds[lead] == NUMBER] + 1] = False
        quote = np.flatnonzero(raw == 39)
        quote = quote[first[quote] & (kinds[quote] == OTHER)]
        a, b = low[quote + 1], low[quote + 2]
        size = np.where(np.isin(a, list(b"stmd")), 2,
                        np.where((a == 108) & (b == 108) | ((a == 114) | (a == 118)) & (b == 101), 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        first[quote + 1] = False
        first[quote + size] = True
        starts = np.flatnonzero(first)
        kind = kinds[starts]
        kept = kind != SPACE
        offsets = np.zeros(np.count_nonzero(kept) + 1, np.int32)
        np.cumsum(np.diff(starts, append=len(raw))[kept], out=offsets[1:])
        pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                       [None, pa.py_buffer(offsets), pa.py_buffer(low[kinds != SPACE])])
        return pieces, starts[kept], kind[kept] == RARE

    def learn(self, new: pa.Array, rare: np.ndarray) -> None:
        """Pieces go through the library's model, rarer words through all of it."""
        common = new.filter(pa.array(~rare)).to_pylist()
        letters = b"\n".join(common).decode("latin-1").translate(self.letters).split("\n") if common else []
        found = [list(map(TOKEN_ID, self.model.tokenize(piece))) for piece in letters]
        words = [w.decode() for w in new.filter(pa.array(rare)).to_pylist()]
        found += [e.ids for e in self.codec.library.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.empty(len(new), np.int32)
        sizes[np.argsort(rare, kind="stable")] = counts = np.fromiter(map(len, found), np.int32, len(found))
        begins = np.empty(len(new), np.int32)
        begins[np.argsort(rare, kind="stable")] = len(self.ids) + np.cumsum(counts, dtype=np.int32) - counts
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, counts.sum())])
        self.begins, self.sizes = np.concatenate([self.begins, begins]), np.concatenate([self.sizes, sizes])

    def recall(self, pieces: pa.Array, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces one after the other, and how many each has."""
        known = len(self.old) + len(self.young)
        numbered = pa.concat_arrays([self.old, self.young, pieces]).dictionary_encode()
        every, at = numbered.dictionary, numbered.indices.to_numpy()[known:]
        whole = np.zeros(len(every), bool)
        whole[at[rare]] = True
        self.learn(every[known:], whole[known:])
        self.used[at[at < len(self.old)]] = True
        self.young = every[len(self.old):]
        sizes = self.sizes[at]
        found = gathered(self.ids, self.begins[at], sizes)
        bulk = pc.sum(pc.binary_length(self.young), min_count=0).as_py()
        if len(self.young) + np.count_nonzero(self.used) > MEMO // 2 or bulk > MEMO_BYTES // 2:
            kept = np.concatenate([np.flatnonzero(self.used), np.arange(len(self.old), len(every))])
            self.ids, self.sizes = gathered(self.ids, self.begins[kept], self.sizes[kept]), self.sizes[kept]
            self.begins = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
            self.old, self.young, self.used = every.take(pa.array(kept)), every[:0], np.zeros(len(kept), bool)
        return found, sizes

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        pieces, starts, rare = self.split(b"\n".join([b"", *texts, b"\n"]))
        found, sizes = self.recall(pieces, rare)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bounds = ends[np.searchsorted(starts, places)].tolist()
        return [found[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def gathered(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` that begin at ``begins``, one after the other; fewer than 2 ** 31 in all."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]


def _byte_letters() -> dict[int, str]:
    """The byte-level pre-tokenizer's letter of each byte: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


@lru_cache(maxsize=4)
def codec(vocabulary: str):
    """The library object of a vocabulary file, once per worker."""
    path = public_tokenizers.path(vocabulary)
    return JsonCodec(path) if path.endswith(".json") else PieceCodec(path)


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds | None:
    """The word memory, if the file's parts prove that words can be encoded alone."""
    c = codec(vocabulary)
    if not isinstance(c, JsonCodec):
        return None
    config = json.loads(c.library.to_str())
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    normal = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
    drops_space = (steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
                   and steps[0]["pattern"].get("Regex") == PIECES)
    plain = (len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]
             and not steps[1]["use_regex"] and normal == ["NFC", "Replace", "Lowercase"]
             and config["post_processor"] is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or
                                                              len(t["content"].split()) != 1 for t in config["added_tokens"]))
    return WordIds(c) if drops_space and plain else None


# Kinds of characters, as the pre-tokenizer tells them apart; rarer ones (from U+0300) and those that
# change their length when lowered may change in normal form or lower as a whole
SPACE, LETTER, NUMBER, OTHER, RARE = range(5)
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _kind(c: str) -> int:
    return next(k for k, p in enumerate((r"\s", r"\p{L}", r"\p{N}", "(?s:.)")) if regex.fullmatch(p, c))


def _tables() -> tuple[np.ndarray, ...]:
    """Kinds and lowered bytes of ASCII characters by byte, and of others by first byte and second."""
    kinds, lower = np.full(256, RARE, np.uint8), np.arange(256, dtype=np.uint8)
    kinds[:128] = [_kind(chr(c)) for c in range(128)]
    lower[65:91] += 32
    long_kinds, long_lower = np.full(4096, RARE, np.uint8), np.zeros((4096, 2), np.uint8)
    for c in range(0x80, 0x300):
        low = chr(c).lower().encode()
        if len(low) == 2:
            long_kinds[c], long_lower[c] = _kind(chr(c)), list(low)
    return kinds, lower, long_kinds, long_lower


KINDS, LOWER, LONG_KINDS, LONG_LOWER = _tables()
GAPS = np.isin(np.arange(256), list(b" \t\n\v\f\r"))     # what the word memory's words lie between
TOKEN_ID = attrgetter("id")

# Boundaries that hold whatever stands further left or right: a white space between two characters that
# are not, and, where a pre-tokenizer takes runs of letters as words of their own, the end of such a run
SPACED = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])[ \n\t](?=[\p{L}\p{N}])")
RUNS = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])[ \n\t](?=[\p{L}\p{N}])|(?<=\p{L})(?=[\p{N}\p{P}])")


def splice_point(left, right, lo: int, hi: int, places: list[int]) -> tuple[int, int] | None:
    """(tokens of left before, tokens of right before) a stable boundary between lo and hi, if any.

    ``left`` and ``right`` are (ids, starts, ends) with offsets in the whole text; ``places`` are candidates.
    """
    for p in reversed([q for q in places if lo < q < hi]):
        i, j = int(np.searchsorted(left[1], p)), int(np.searchsorted(right[1], p))
        clean = (i == 0 or left[2][i - 1] <= p) and (j == 0 or right[2][j - 1] <= p)
        first = int(np.searchsorted(right[1], lo))      # tokens of the overlap up to p, in both
        n = j - first
        if clean and 0 < n <= i and np.array_equal(left[0][i - n:i], right[0][first:j]) and \
                np.array_equal(left[2][i - n:i], right[2][first:j]):
            return i, j
    return None


def spliced(c, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """ids of a huge text from overlapping chunks; no overlap is encoded that holds no candidate."""
    out, begin, end, skip = [], 0, min(chunk, len(text)), 0
    left = c.encode(text[:end])                     # of text[begin:end]; ``skip`` of its tokens are done
    while end < len(text):
        cut, wide = None, overlap
        places = [m.start() for m in c.boundaries.finditer(text, begin + GUARD, end - GUARD)]
        while cut is None and places and end - wide > begin:
            start = end - wide
            if places[-1] > start + GUARD:          # else nothing to try yet
                stop = min(len(text), end + chunk)
                ids, a, b = c.encode(text[start:stop])
                right = ids, a + start, b + start
                cut = splice_point(left, right, start + GUARD, end - GUARD, places)
            wide *= 2
        if cut is None:                             # no boundary in the whole chunk: double it
            stop = min(len(text), end + max(chunk, end - begin))
            ids, a, b = c.encode(text[begin:stop])
            left, end = (ids, a + begin, b + begin), stop
            continue
        out.append(left[0][skip:cut[0]])
        left, begin, end, skip = right, start, stop, cut[1]
    return np.concatenate([*out, left[0][skip:]])


def ids_bytes_of(vocabulary: str, texts: list[bytes]) -> Iterator[bytes]:
    """The ids of whole texts as little-endian unsigned 32-bit numbers, in order."""
    c, words = codec(vocabulary), word_ids(vocabulary)
    some, size = [], 0
    for k, text in enumerate(texts):
        some.append(text)
        size += len(text)
        if size < SLICE and k + 1 < len(texts):
            continue
        short = [t for t in some if len(t) <= HUGE]
        found = iter(words.ids_of(short) if words is not None else
                     (c.ids(t.decode()).astype("<u4").tobytes() for t in short))
        for t in some:
            yield next(found) if len(t) <= HUGE else spliced(c, t.decode()).astype("<u4").tobytes()
        some, size = [], 0


def ids_bytes(vocabulary: str, text: bytes) -> bytes:
    """The ids of one whole text."""
    return next(ids_bytes_of(vocabulary, [text]))


def _counts(vocabulary: str):
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(x) // 4 for x in ids_bytes_of(vocabulary, texts)], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row; no shuffle."""
    return (map_arrow(doc_texts(docs), _counts(vocabulary), "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
