from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shotgrid.llm import host_rules as R

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else \
        {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_measures_equal_brute_force(spark, documents):
    odd = [None, "", "a", "a b c a b c", "a b c\na b c\n\n \na b c", "x\x0bx\x0cx\x1cx", "é é é é é", "a a a a", "%%% # é|"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").union(
        documents(*[(10**6 + i, t) for i, t in enumerate(odd)]))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = R.measures(docs).collect()
    assert len(got) == len(text)
    for r in got:
        want = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def good(i):
    return " ".join(f"word{i}x{k}" for k in range(60))


def test_host_verdicts_and_prior(documents):
    rows = [(i, good(i), f"h{i % 8}") for i in range(400)]
    rows += [(1000 + i, good(i).replace("w", "%w"), "bad") for i in range(90)] + [(1090 + i, good(5000 + i), "bad") for i in range(10)]
    rows += [(2000, "short", "tiny")]
    docs = documents(*rows).withColumn("kept", F.lit("clash")).withColumn("host", F.lit("x"))
    got = {r.doc_id: r for r in R.judge(docs).collect()}
    assert all(got[i].kept for i in range(400))
    assert not any(got[1000 + i].kept for i in range(100))     # the host is rejected as a whole
    assert got[1000].host_rate > 0.5 and not got[1000].base_failed
    assert got[2000].base_failed and got[2000].host_rate < 0.8  # one document is drawn towards the prior
    hosts = R.host_verdicts(R.measures(docs)).collect()
    rates = [h.failures / h.n for h in hosts]
    m = sum(rates) / len(rates)
    var = sum((x - m) ** 2 for x in rates) / len(rates)
    spread = var - m * (1 - m) * sum(1 / h.n for h in hosts) / len(hosts)
    weight = min(max(m * (1 - m) / spread - 1, 1), R.MAX_PRIOR)
    for h in hosts:
        assert h.rate == pytest.approx((h.failures + m * weight) / (h.n + weight))


def test_defined_cases(documents):
    rows = [(1, None, None), (2, "", None), (3, good(1), None), (3, good(1), None), (None, good(2), "a"), (4, "w " * 100_000, "a")]
    got = sorted(((r.doc_id or 0), r.kept, r.base_failed) for r in R.judge(documents(*rows)).collect())
    assert got == [(0, True, False), (1, False, True), (2, False, True), (3, True, False), (3, True, False), (4, False, True)]
    assert R.judge(documents(*rows).where("false")).count() == 0


def test_limit_follows_from_the_prior(documents):
    bad = lambda i: good(i).replace("w", "%w")
    rows = [(h * 100 + i, bad(i) if (i * 7 + h) % 10 == 0 else good(i), f"h{h}") for h in range(30) for i in range(60)]
    rows += [(90_000 + i, bad(i) if i % 2 else good(i), "half") for i in range(200)]       # far above the others
    rows += [(95_000 + i, bad(i) if i < 2 else good(i), "small") for i in range(4)]        # as high, but four rows
    got = {r.source: r for r in R.host_verdicts(R.measures(documents(*rows))).collect()}
    assert {s for s, r in got.items() if r.rejected} == {"half"}
    assert got["half"].rate < 0.55 and got["small"].failures * 2 == got["small"].n
    kept = {r.doc_id: r.kept for r in R.judge(documents(*rows)).collect()}
    assert not any(kept[90_000 + i] for i in range(200)) and all(kept[95_000 + i] for i in range(4))
