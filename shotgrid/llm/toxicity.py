"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding: compatibility forms, lower case, look-alike letters of other scripts
and digits or signs that stand for letters become one plain letter; what is
not a letter separates words. Lexicon entries are word beginnings, so that one
entry finds all inflections of a stem; exception phrases (entry with the word
before or after) cancel the hits they cover.

Learning (only from rows of ``labels`` that the caller passes): at most
``MAX_TRAIN`` labelled documents, chosen by a hash of their id; copies are
reduced to one by their smallest shingle hash, otherwise a text copied often
would put its rare words into the lexicon. Weights are smoothed log odds of
document counts; word beginnings that a shorter entry explains as well are left
out. Length-normalised weight and total weight go through a logistic curve
fitted on the same rows. The model is at most ``MAX_TERMS`` entries, out of four
times as many candidates, and as many exception phrases: beyond these bounds the
candidates and entries of the least weight times documents and the phrases of the
fewest documents are left out.

Scoring reads every whole text. Defined cases: null, empty or wordless texts
have no hits and get the score of none; texts of any length are scanned whole;
without labelled rows of both kinds the lexicon is empty and all scores are 0;
repeated rows are scored alike; empty ``documents`` give no rows, other columns are
not read; a null doc_id is never held out.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.llm.common import doc_texts, map_arrow, stash, utf8
from shotgrid.llm.near_dedup import shingles

MAX_TRAIN = 16_000   # labelled documents the model is fitted on
MAX_TERMS = 5_000    # lexicon entries
PREFIX = (3, 12)     # lengths of lexicon entries
MIN_SHARE = 0.01     # of toxic training documents that must hold an entry, and MIN_DOCS of them
MIN_DOCS = 5
MIN_WEIGHT = 3.0     # log odds an entry must reach
THRESHOLD = 0.3

# Look-alike letters and the digits and signs used as letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
          "!": "i", "|": "i", "l": "i"}  # l, 1, i, ! and | are taken for one another


class _Fold(dict):
    """Code point -> folded letters, a space, or nothing; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKC", chr(code)).lower():
            c = LOOK_ALIKE.get(c, c)
            c = DIGITS.get(c, c)
            kind = unicodedata.category(c[0])
            if c.isalpha():
                out.append(c)
            elif kind not in ("Mn", "Cf"):  # marks and invisible characters vanish
                out.append(" ")
        self[code] = value = "".join(out)
        return value


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded text with a space before each word (and possibly more)."""
    return " " + text.translate(_FOLD) + " "


@dataclass
class Model:
    """weights: word beginning -> weight; exceptions: phrases; curve: logistic (bias, total, rate)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def automaton(self):
        auto = ahocorasick.Automaton()
        for term, w in self.weights.items():
            auto.add_word(" " + term, (len(term) + 1, w))
        for phrase in self.exceptions:
            auto.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(auto):
            auto.make_automaton()
        return auto


def hits(auto, folded: str) -> tuple[float, int]:
    """Sum of weights and number of lexicon hits outside exception phrases; one per word, the longest."""
    if not len(auto):
        return 0.0, 0
    found, covered = {}, []
    for end, (length, w) in auto.iter(folded):
        start = end - length + 1
        if w is None:
            covered.append((start, end))
        else:
            found[start] = w
    for a, b in covered:
        for start in [s for s in found if a <= s < b]:
            del found[start]
    return sum(found.values()), len(found)


def features(total: float, n_chars: int) -> tuple[float, float]:
    """Total weight and weight per hundred words (of six characters), both in logs."""
    return float(np.log1p(total)), float(np.log1p(600.0 * total / max(n_chars, 60)))


def score(model: Model, total: float, n_chars: int) -> float:
    if not model.weights:
        return 0.0
    x, y = features(total, n_chars)
    b, p, q = model.curve
    return float(1.0 / (1.0 + np.exp(-np.clip(b + p * x + q * y, -35, 35))))


def beginnings(folded: str) -> set[str]:
    lo, hi = PREFIX
    return {w[:k] for w in set(folded.split()) for k in range(lo, min(hi, len(w)) + 1)}


def _count_beginnings(batches):
    for batch in batches:
        pos, neg = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (pos if toxic else neg).update(beginnings(fold(text)))
        terms = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()),
             pa.array([neg[t] for t in terms], pa.int64())], ["term", "pos", "neg"])


def _least_shingle(batches):
    for batch in batches:
        least = [int(s[0] >> np.uint64(1)) if len(s) else -1 for s in map(shingles, utf8(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.int64())], ["doc_id", "least"])


def _phrases(model: Model):
    def run(batches):
        auto = model.automaton()
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, seen = fold(text).split(), Counter()
                for i, w in enumerate(words):
                    if any(w.startswith(t) for t in _starts(auto, w)):
                        seen.update(" ".join(x) for x in (words[i - 1:i + 1], words[i:i + 2]) if len(x) == 2)
                rows += [(p, 1, toxic) for p in seen]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64())], ["phrase", "docs", "toxic"])
    return run


def _starts(auto, word: str) -> list[str]:
    return [word[:n - 1] for end, (n, w) in auto.iter(" " + word) if w is not None and end == n - 1] if len(auto) else []


def _totals(model: Model):
    def run(batches):
        auto = model.automaton()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([hits(auto, fold(t))[0] for t in texts], pa.float64()),
                 pa.array([len(t) for t in texts], pa.int64()), batch.column(1)], ["total", "n_chars", "toxic"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes are kept from falling."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-3, 0.3, 0.3])
        step = np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, 0.3, 0.3]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0)), float(max(w[2], 0.0))


def lexicon(terms: dict[str, tuple[float, int]], limit: int = MAX_TERMS) -> dict[str, float]:
    """Entries out of candidate word beginnings (weight, toxic documents).

    A beginning is lengthened while one longer candidate holds nearly all of its
    documents (idi -> idiot), and left out if a chosen shorter one explains it.
    Of more than ``limit`` entries those of the most evidence stay: weight times documents.
    """
    longer: dict[str, list[str]] = {}
    for t in terms:
        longer.setdefault(t[:-1], []).append(t)
    out: dict[str, float] = {}
    for t in sorted(terms, key=lambda t: (len(t), t)):
        if any(t[:k] in out for k in range(PREFIX[0], len(t))):
            continue
        if any(terms.get(x, (0, 0))[1] >= 0.9 * terms[t][1] for x in longer.get(t, ())):
            continue  # its one continuation stands for it
        out[t] = float(terms[t][0])
    strongest = sorted(out, key=lambda t: (-out[t] * terms[t][1], t))[:limit]
    return {t: out[t] for t in strongest}


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of at most about ``limit`` labelled documents, copies reduced to one."""
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("long")).alias("toxic"))
    n = chosen.count()
    if n > limit:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < limit)
    rows = doc_texts(docs).join(F.broadcast(chosen), "doc_id")  # at most about ``limit`` small rows
    least = map_arrow(rows.select("doc_id", "text"), _least_shingle, "doc_id long, least long")
    one = least.groupBy("least").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    return rows.join(F.broadcast(one), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Model:
    """Learn lexicon, exceptions and curve; ``labels`` holds only rows that may be used."""
    rows = stash(training_rows(docs, labels, limit), "toxicity")
    sizes = {r.toxic > 0: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = sizes.get(True, 0), sizes.get(False, 0)
    if not p or not n:
        return Model()
    odds = F.log((F.col("pos") + 0.5) / (p + 1.0)) - F.log((F.col("neg") + 0.5) / (n + 1.0))
    terms = (map_arrow(rows, _count_beginnings, "term string, pos long, neg long")
             .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
             .where(F.col("pos") >= max(MIN_DOCS, MIN_SHARE * p)).withColumn("w", odds).where(F.col("w") >= MIN_WEIGHT)
             .orderBy(F.desc(F.col("w") * F.col("pos")), "term").limit(4 * MAX_TERMS).collect())
    model = Model(weights=lexicon({r.term: (r.w, r.pos) for r in terms}))
    if not model.weights:
        return Model()
    phrases = (map_arrow(rows, _phrases(model), "phrase string, docs long, toxic long")
               .groupBy("phrase").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
               .where("docs >= 5 and toxic <= 0.1 * docs").orderBy(F.desc("docs"), "phrase").limit(MAX_TERMS).collect())
    model.exceptions = [r.phrase for r in phrases]
    got = map_arrow(rows, _totals(model), "total double, n_chars long, toxic long").collect()  # at most ``limit`` rows
    x = np.array([features(r.total, r.n_chars) for r in got])
    model.curve = _logistic(x, np.array([float(r.toxic > 0) for r in got]))
    return model


def _score(model: Model):
    def run(batches):
        auto = model.automaton()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [hits(auto, fold(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([score(model, w, len(t)) for (w, _), t in zip(found, texts)], pa.float64()),
                 pa.array([k for _, k in found], pa.int64())], ["doc_id", "score", "n_hits"])
    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_hits, predicted), one row per input row."""
    return (map_arrow(doc_texts(docs), _score(model), "doc_id long, score double, n_hits long")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def held_out(column: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` below the threshold, scored in one pass without a shuffle."""
    def run(batches):
        auto = model.automaton()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = [score(model, hits(auto, fold(t or ""))[0], len(t or "")) < THRESHOLD for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return map_arrow(docs, run, docs.schema)
