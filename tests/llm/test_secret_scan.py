from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotgrid.llm import secret_scan as S

SF = "/root/testdata/sf0.01"


def brute(text):
    """The base rules as stated: every match of the plain patterns, short ones dropped."""
    out = []
    assign = re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
                        r"[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for rank, (kind, pattern, keep) in enumerate((("assign", assign, lambda m: len(m[2]) >= 6),
                                                  ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
                                                  ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if keep(m)]
    return [s for *_, s in sorted(out)]


@pytest.fixture(scope="module")
def model(spark):
    return S.fit(spark.read.parquet(f"{SF}/documents.parquet"))


ODD = [None, "", "token=abc token = 'abcdef' TOKEN:\"a.b-c_d\"", "paſſword=abcdefgh", "passwordpassword==xyz123456", "AKIA" + "A" * 15,
       "AKIAAKIA" + "Z" * 16 + " é😀AKIA" + "0" * 16, "0" * 23 + " " + "f" * 24 + "G" + "a" * 40, "xAKIA1AKIA" + "B" * 14,
       "secret=a=secret=bcdefg", "api_key apikey:'" + "0123456789abcdef" * 2 + "'", "token=\n123456", "token=" + "a" * 100_000]


def test_base_spans_equal_brute_force(spark, documents, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").union(
        documents(*[(10**6 + i, t) for i, t in enumerate(ODD)]))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = S.scan(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == want


def test_markov_ratio_tells_random_from_ordinary(model):
    rng = random.Random(9)
    secrets = ["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(100)]
    secrets += ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(22)) for _ in range(100)]
    plain = [f"{a}_{b}_{c}{n}" for a in ("theation", "reading", "hereand") for b in ("ingther", "onthat") for c in ("entire",) for n in (1, 2025)]
    hit = lambda run: bool(S.random_spans(f"see {run} there", [], model))
    assert sum(map(hit, secrets)) >= 0.95 * len(secrets)
    assert not any(map(hit, plain)) and not hit("4041894974608795") and not hit("averylongordinarywordwithoutdigits")


def test_letters_alone_can_be_random(model):
    rng = random.Random(5)
    hit = lambda run: bool(S.random_spans(f"see {run} there", [], model))
    for letters, share in (("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.95), ("abcdefghijklmnopqrstuvwxyz", 0.8), ("abcdefghijklmnop", 0.8)):
        assert sum(hit("".join(rng.choice(letters) for _ in range(20))) for _ in range(200)) >= share * 200
    assert not any(map(hit, ("=" * 40, "-" * 40, "1234567890123456", "internationalization", "Donaudampfschifffahrtsgesellschaft")))


def test_limit_is_calibrated_on_all_runs(documents):
    rng = random.Random(3)
    secrets = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(22)) for _ in range(3000)]
    plain = sorted({"-".join(rng.choice(("here", "there", "reading", "words", "of", "text", "and")) for _ in range(5)) + f"-{rng.randint(1, 99)}"
                    for _ in range(4000)})
    plain += ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(22)) for _ in range(60)]   # the limit is above 0
    docs = documents(*[(i, f"token={s}") for i, s in enumerate(secrets)], *[(9000 + i, f"see {p} here") for i, p in enumerate(plain)])
    one, many = S.fit(docs.coalesce(1)), S.fit(docs.repartition(16))
    assert one.limit == many.limit
    runs = [p for p in plain if len(p) >= 16]
    assert len(runs) > 2000
    low, high = (np.quantile([one.mean(r) for r in rs], q, method="lower") for rs, q in ((secrets, 0.02), (runs, 0.999)))
    assert one.limit > 0 and abs(one.limit - ((low + high) / 2 if high < low else low)) < 0.01


def test_trigram_counts_do_not_depend_on_slices():
    data = " ".join(f"ab{i}Z-é" for i in range(500)).encode()
    assert (S.count_trigrams(data) == S.count_trigrams(data, 7)).all()


def test_redaction_and_defined_cases(documents, model, spark):
    rows = [(1, None), (2, ""), (3, "my password=hunter22 and AKIA" + "Q" * 16 + "!"), (3, "my password=hunter22 and AKIA" + "Q" * 16 + "!"),
            (None, "token: '" + "ab12" * 8 + "'"), (4, "plain words " * 20_000)]
    docs = documents(*rows).withColumn("spans", F.lit("clash")).withColumn("kind", F.lit("x"))
    out = S.redact_secrets(docs, model)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    text = "my password=[secret] and [secret]!"
    assert got[3] == (text, len(text)) and got[None][0] == "token: '[secret]'" and got[1] == (None, 0) and got[4][0] == rows[-1][1]
    assert S.scan(out, model).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0] in (0, 1)
    empty = docs.where("false")
    assert S.scan(empty, model).count() == 0
    untrained = S.fit(empty)
    assert untrained.ratio is None and S.scan(docs, untrained).where("n_random > 0").count() == 0


def test_many_base_spans_take_linear_time(spark):
    text = " ".join(f"token={i:08d}abc word{i} AKIA{'A' * 16}{i}" for i in range(15_000))
    assert len(text) > 600_000
    base = S.base_spans(text)
    assert len(base) >= 30_000
    covered = S.Covered(base)
    rng = random.Random(2)
    for _ in range(300):
        a = rng.randrange(len(text) - 30)
        b = a + rng.randint(1, 30)
        assert covered.meets(a, b) == any(x < b and a < y for x, y, *_ in base)
    began = time.process_time()
    model = S.Model(np.zeros(S.SYMBOLS ** 3), 1.0)
    assert [s for s in S.spans(text, model) if s[2] != "random"] == sorted(base, key=lambda s: (s[0], S.KINDS.index(s[2]), s[1]))
    assert time.process_time() - began < 20
