from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from shotgrid.llm import near_dedup

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """component of each id by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in root}


def check(docs, rows):
    got = near_dedup.near_duplicates(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, set()).add(len(shingle_set(t)))
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)
    return got


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def edits(base, rng, share):
    return " ".join(f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in base)


def test_big_groups_common_passage_and_chains(documents, monkeypatch):
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(10**6)
    rows, n = [], iter(range(10**6))
    base = [word() for _ in range(120)]
    rows += [(next(n), edits(base, rng, 0.02)) for _ in range(120)]       # one large near-copy group
    passage = [word() for _ in range(60)]
    rows += [(next(n), " ".join(passage + [word() for _ in range(rng.choice((12, 25, 60)))])) for _ in range(150)]
    chain = [word() for _ in range(80)]
    for k in range(0, 60, 5):                                              # neighbours linked, ends far apart
        rows.append((next(n), " ".join(chain[k:] + [f"c{j}" for j in range(k)])))
    rows += [(next(n), "same text again and again here")] * 1 + [(next(n), "Same TEXT again and again here")]
    rng.shuffle(rows)
    check(documents(*rows), rows)


def test_threshold_is_exact(documents):
    words = [f"w{i}" for i in range(39)]
    a = " ".join(words[:39])                       # 35 shingles
    rows = [(1, a), (2, " ".join(words[5:39])), (3, " ".join(words[:20])), (4, " ".join(words[:35] + ["q"] * 4))]
    check(documents(*rows), rows)


def test_defined_cases(documents, spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One\ttwo"), (6, "one"), (None, "one two"),
            (7, "a b c d e f g h"), (7, "completely other words in this second text"),
            (8, "completely other words in this second text"), (9, "A b c d e f g h"), (9, "A b c d e f g h"),
            (10, "long " * 30000)]
    got = near_dedup.near_duplicates(documents(*rows)).collect()
    comp = {}
    for r in got:
        comp.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert len(got) == len(rows)
    assert comp[None] == {(None, True)}
    assert [comp[i] for i in (1, 2, 3)] == [{(i, True)} for i in (1, 2, 3)]
    assert comp[4] == {(4, True)} and comp[5] == {(4, False)} and comp[6] == {(6, True)}
    assert comp[7] == {(7, True)} and comp[8] == {(7, False)} and comp[9] == {(7, False)}
    empty = documents(*rows).where("false")
    assert near_dedup.near_duplicates(empty).count() == 0


def test_drop_keeps_columns_and_one_row_per_group(documents):
    from pyspark.sql import functions as F
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words entirely here now ok"), (3, "other words entirely here now ok"), (None, "a b c d e f")]
    docs = documents(*rows).withColumn("kept", F.lit("clash")).withColumn("component_id", F.lit("x"))
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == [(False, 0), (True, 1), (True, 3)]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_shingle_sizes(n):
    assert len(near_dedup.shingles(" ".join(f"w{i}" for i in range(n)).encode())) == (0 if n == 0 else max(1, n - 4))
