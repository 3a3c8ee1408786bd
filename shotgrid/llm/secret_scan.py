"""Secret scans: base patterns plus character Markov models of random strings.

Base spans (code points, end exclusive) are leftmost and non-overlapping per
kind: ``assign`` (a named value of 6+ characters), ``access`` (AKIA..., 20+) and
``hex`` (24+ digits). The method adds spans of kind ``random``: runs of 16 or
more characters of secrets (letters, digits, ``+/_=-``) with a letter (numbers
and ruled lines are none), outside base spans, whose log-likelihood ratio per character between a
model of random strings and one of ordinary text reaches a calibrated limit.

Training: the labelled samples are the corpus itself. The values in base spans
are the random strings; all other runs are the ordinary identifiers and words.
Character trigrams of both are counted over every whole text and added up
before the shuffle; at most ``SYMBOLS**3`` counts of each kind exist whatever
the corpus holds, which bounds what the driver gets and sends. The limit is
calibrated on all distinct secrets and ordinary long runs: Spark scores each
once and counts them in ``BINS`` equal bins over the range of the ratios, so the
quantiles are right to a bin and depend on the rows alone.

Defined cases: null or empty texts have no spans (the digest is that of the
empty string); a corpus without any secret gives an untrained model that adds
no spans; very long texts are scanned whole; repeated rows get equal results;
a null doc_id is scanned like any other.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.llm.common import doc_texts, map_arrow, stash

KINDS = ("assign", "access", "hex", "random")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
SYMBOLS = len(ALPHABET) + 1          # 0 stands for anything else: the edge of a run
MIN_RANDOM = 16
BINS = 1 << 16                       # of the calibration histogram of each kind
REDACTED = "[secret]"
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_LONG = re.compile(r"(?<!\S)\S{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_CODE = np.zeros(256, np.int32)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, SYMBOLS)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret value) of the base patterns, by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign", m.start(1)) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    for word in _LONG.finditer(text):
        out += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text, word.start(), word.end())]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@dataclass
class Model:
    """ratio: log-likelihood ratio of each trigram; limit: least mean per character."""

    ratio: np.ndarray | None = None
    limit: float = float("inf")

    def mean(self, run: str) -> float:
        return float(self.ratio[trigrams(run.encode())].mean())


def trigrams(data: bytes) -> np.ndarray:
    """Codes of each character with the two before it; runs are told apart by code 0."""
    c = np.concatenate([np.zeros(2, np.int32), _CODE[np.frombuffer(data, np.uint8)]])
    return (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]


def count_trigrams(data: bytes, slice_bytes: int = 1 << 20) -> np.ndarray:
    """How often each trigram occurs, in slices of bounded memory."""
    n = np.zeros(SYMBOLS ** 3, np.int64)
    for at in range(0, len(data), slice_bytes):
        before = min(at, 2)
        n += np.bincount(trigrams(data[at - before:at + slice_bytes])[before:], minlength=len(n))
    return n


class Covered:
    """Asks whether a stretch meets one of some spans, in logarithmic time."""

    def __init__(self, base: list):
        spans = sorted((a, b) for a, b, *_ in base)
        self.starts, self.ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def meets(self, start: int, end: int) -> bool:
        n = bisect_left(self.starts, end)
        return n > 0 and self.ends[n - 1] > start


def random_spans(text: str, base: list, model: Model) -> list[tuple[int, int, str, int]]:
    """Runs outside the base spans that look random."""
    if model.ratio is None:
        return []
    out, covered = [], Covered(base)
    for word in _LONG.finditer(text):
        for m in _RUN.finditer(text, word.start(), word.end()):
            run = m[0]
            if (any(c.isalpha() for c in run)
                    and not covered.meets(m.start(), m.end())
                    and model.mean(run) >= model.limit):
                out.append((m.start(), m.end(), "random", m.start()))
    return out


def spans(text: str, model: Model) -> list[tuple[int, int, str, int]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, base, model), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(found) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in found)


def redact(text: str, found) -> str:
    """The text with each secret value (overlaps merged) replaced."""
    out, at = [], 0
    for value, end in sorted((value, end) for _, end, _, value in found):
        if value >= at:
            out += [text[at:value], REDACTED]
        at = max(at, end)
    return "".join(out) + text[at:]


def _count(batches):
    """Rows (kind, code, n) of trigram counts and (kind, run) of a batch's distinct runs."""
    for batch in batches:
        secrets, rest, ordinary = [], [], set()
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            covered = Covered(base)
            at = 0
            for start, end, kind, value in base:
                secrets.append(text[value:end])
                rest.append(text[at:max(at, start)])
                at = max(at, end)
            rest.append(text[at:])
            ordinary.update(m[0] for word in _LONG.finditer(text) for m in _RUN.finditer(text, word.start(), word.end())
                            if not covered.meets(m.start(), m.end()))
        rows = []
        for kind, parts, runs in (("secret", secrets, set(secrets)), ("plain", rest, ordinary)):
            n = count_trigrams(b"  ".join(t.encode() for t in parts if t))   # two edges: no part is another's context
            codes = np.flatnonzero(n)
            rows += [(kind, int(c), int(k), None) for c, k in zip(codes, n[codes])]
            rows += [(kind, None, 0, r) for r in runs]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())],
            ["kind", "code", "n", "run"])


def _log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Interpolated order-2 model: each order is smoothed towards the one below."""
    c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    c[:, :, 0] = 0.0                                    # edges are context only
    p = (c.sum((0, 1)) + 0.5) / (c.sum() + 0.5 * SYMBOLS)
    for n, alpha in ((c.sum(0), 8.0), (c, 8.0)):
        p = (n + alpha * p) / (n.sum(-1, keepdims=True) + alpha)
    return np.log(p).reshape(-1)


def _bins(model: Model, low: float, width: float):
    """Rows (kind, bin) of the mean ratio of each run."""
    def run(batches):
        for batch in batches:
            means = np.array([model.mean(r) for r in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.clip((means - low) // width, 0, BINS - 1).astype(np.int32), pa.int32())],
                ["kind", "bin"])
    return run


def quantile(counts: np.ndarray, q: float) -> int:
    """The bin that holds the value of rank ``q`` (from 0 to 1) of a histogram."""
    return int(np.searchsorted(np.cumsum(counts), q * (counts.sum() - 1), side="right"))


def fit(docs: DataFrame) -> Model:
    """Train on all texts of ``docs``; the two results are bounded by the alphabet and BINS."""
    counted = stash(map_arrow(docs.select(F.coalesce("text", F.lit("")).alias("text")), _count,
                              "kind string, code int, n long, run string")
                    .groupBy("kind", "code", "run").agg(F.sum("n").alias("n")), "secrets")
    counts = {"secret": np.zeros(SYMBOLS ** 3, np.int64), "plain": np.zeros(SYMBOLS ** 3, np.int64)}
    for r in counted.where("run is null").select("kind", "code", "n").toLocalIterator():
        counts[r.kind][r.code] = r.n
    if not counts["secret"].any():
        return Model()
    model = Model((_log_probabilities(counts["secret"]) - _log_probabilities(counts["plain"])).astype(np.float32))
    bottom = float(model.ratio.min())                   # no mean lies outside the ratios
    width = max((float(model.ratio.max()) - bottom) / BINS, 1e-9)
    runs = counted.where("run is not null and (kind = 'secret' or run rlike '[A-Za-z]')").select("kind", "run")
    binned = map_arrow(runs, _bins(model, bottom, width), "kind string, bin int").groupBy("kind", "bin").agg(F.count("*").alias("n"))
    seen = {kind: np.zeros(BINS, np.int64) for kind in counts}
    for r in binned.toLocalIterator():
        seen[r.kind][r.bin] = r.n
    low = bottom + width * quantile(seen["secret"], 0.02)
    high = bottom + width * (quantile(seen["plain"], 0.999) + 1) if seen["plain"].any() else -1.0
    model.limit = float(max(0.0, (low + high) / 2 if high < low else low))
    return model


def _scan(model: Model):
    def run(batches):
        for batch in batches:
            found = [spans(t, model) for t in batch.column(1).to_pylist()]
            base = [[s for s in f if s[2] != "random"] for f in found]
            count = lambda kind: pa.array([sum(s[2] == kind for s in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count("assign"), count("access"), count("hex"), count("random"),
                 pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string()),
                 pa.array(list(map(written, found)), pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])
    return run


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans), one row per input row."""
    return map_arrow(doc_texts(docs), _scan(model),
                     "doc_id long, n_assign long, n_access long, n_hex long, n_random long, "
                     "base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the secret values in ``text`` replaced (and their ``n_chars``, if there, counted anew)."""
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text")).to_pylist()
            clean = [t if t is None else redact(t, spans(t, model)) for t in texts]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(clean, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([n if t == c else len(c) for n, t, c in zip(batch.column(k).to_pylist(), texts, clean)],
                                      batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names)
    return map_arrow(docs, run, docs.schema)
