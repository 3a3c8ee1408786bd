"""Quality rules at the level of hosts, with an empirical beta prior.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. One pass measures every
document; a document fails when a base rule or one of ``RULES`` is broken.
Failures are added up by host (``source``); a host's rate is shrunk towards all
hosts by a beta prior whose two parameters come from the hosts' own rates by
the method of moments, so a host with few documents is judged mostly by what is
usual, one with many by its own. A host is rejected if its shrunk rate lies more
than ``SPREADS`` of the prior's own standard deviations above the prior's mean,
where a host like the others hardly ever lies, or above ``MAJORITY``; the verdict
is joined back to its documents. So the limit follows from the hosts: where they
differ by chance alone, the prior is narrow but draws every host to its mean; where
they differ widely, only a host most of whose documents fail is rejected.

Base rule: fewer than 50 words, or more than half of the words in 3-word
windows that occur twice or more.

Defined cases: a null text has no words and fails the base rule; null sources
are one host; repeated rows count each; a single host (no spread between hosts)
gets the widest prior, of weight ``MAX_PRIOR``; no rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrid.llm.common import map_arrow, stash

MIN_WORDS = 50
SPREADS = 3.0
MAJORITY = 0.5
MAX_PRIOR = 1_000.0
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
# Further rules, as SQL over the measures; a broken one counts as a failure of the host.
RULES = {
    "symbols": "n_symbols > 0.1 * n_words",
    "word_length": "word_chars < 2.5 * n_words or word_chars > 12 * n_words",
    "dup_lines": "n_dup_lines > 0.3 * n_lines",
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    w = (h[:-2] * mul + h[1:-1]) * mul + h[2:]
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[i:i + len(w)] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(words))


def _measure(batches):
    for batch in batches:
        rows = [measure(t or "") for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(6))],
            ["doc_id", "source", *(m.split()[0] for m in MEASURES.split(", "))])


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, source, measures, base_failed, failed), one row per input row."""
    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                 "text"), _measure, f"doc_id long, source string, {MEASURES}")
    base = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")
    rule = F.expr(" or ".join(f"({r})" for r in RULES.values()))
    return rows.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | rule)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of the beta distribution with the hosts' mean rate and spread.

    Moments over hosts: the variance of the rates less what binomial noise
    explains. Only one row reaches the driver.
    """
    r = hosts.agg(F.count("*").alias("k"), F.avg(F.col("failures") / F.col("n")).alias("mean"),
                  F.var_pop(F.col("failures") / F.col("n")).alias("var"), F.avg(1 / F.col("n")).alias("inv")).first()
    if not r.k:
        return 1.0, 1.0
    m = min(max(r.mean, 1e-3), 1 - 1e-3)
    spread = max(r.var - m * (1 - m) * r.inv, 0.0)
    weight = min(max(m * (1 - m) / spread - 1, 1.0), MAX_PRIOR) if spread > 0 else MAX_PRIOR
    return m * weight, (1 - m) * weight


def limit(a: float, b: float) -> float:
    """The rate above which a host is unlike the hosts of the prior."""
    mean = a / (a + b)
    return min(mean + SPREADS * (mean * (1 - mean) / (a + b + 1)) ** 0.5, MAJORITY)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(source, n, failures, rate, rejected): the shrunk failure rate of each host."""
    hosts = stash(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures")),
                  "hosts")
    a, b = beta_prior(hosts)
    rate = (F.col("failures") + a) / (F.col("n") + a + b)
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > limit(a, b))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, failed, host_rate, kept), one row per input row."""
    rows = stash(measures(docs), "measures")
    hosts = host_verdicts(rows).select(F.col("source").alias("host"), F.col("rate").alias("host_rate"), "rejected")
    return (rows.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))
            .drop("host", "source", "rejected"))
