from __future__ import annotations

import random

from pyspark.sql import functions as F

from shotgrid.llm import decontaminate as D


def brute(docs, items):
    """(doc_id, item_id) of every alignment with the wanted overlap, without seeds."""
    out = set()
    for d, text in docs:
        h = D.word_hashes(text or "")
        for i, item in items:
            w = D.word_hashes(item or "")
            need = min(D.MIN_OVERLAP, len(w))
            if len(w) < D.MIN_ITEM:
                continue
            for shift in range(-len(w) + need, len(h) - need + 1):
                a, b = max(0, shift), min(len(h), shift + len(w))
                same = h[a:b] == w[a - shift:b - shift]
                if same.sum() < 0.8 * need:
                    continue
                same = same.tolist()
                if any(sum(same[k:k + need]) >= 0.8 * need for k in range(len(same) - need + 1)):
                    out.add((d, i))
    return out


def found(rows):
    return {(r.doc_id, i) for r in rows for i in r.items}


def test_planted_overlaps_equal_brute_force(spark, documents):
    rng = random.Random(2)
    word = lambda: "w%d" % rng.randrange(400)
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 3, 4, 8, 11, 12, 20, 40])))) for i in range(40)]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.randint(0, 150))]
        if d % 2:
            leak = rng.choice(items)[1].upper().split()
            for k in range(rng.randint(0, 6), len(leak), 6):
                leak[k] = "zz"
            at = rng.randint(0, len(words))
            words[at:at] = [w + "," for w in leak] if d % 3 else leak
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = found(D.contamination(documents(*docs), bench).collect())
    assert got == want and len(want) >= 30


def test_whole_tables_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert found(D.contamination(docs, bench).collect()) == want


def test_defined_cases_and_blocks(spark, documents, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    rows = [(1, None), (2, ""), (3, f"x {item} y"), (3, "other row of the same id"), (None, item),
            (4, "clean words " * 50_000), (5, "Alpha BETA gamma; delta-epsilon zeta eta theta, iota kappa lambda mu nu xi")]
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (None, "one two three"), (5, "p q r s t u v w x1 y1 z1 a1")],
                                  "item_id long, text string")
    docs = documents(*rows).withColumn("contaminated", F.lit("clash")).withColumn("items", F.lit("x"))
    for size in (D.BLOCK_WORDS, 10):
        monkeypatch.setattr(D, "BLOCK_WORDS", size)
        got = {r.doc_id: (r.contaminated, r.items) for r in D.contamination(docs, bench).collect()}
        assert got == {1: (False, []), 2: (False, []), 3: (True, [1, 2]), None: (True, [1, 2]), 4: (False, []), 5: (True, [1, 2])}
        kept = D.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]
    assert D.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert D.contamination(docs.where("false"), bench).count() == 0


def test_items_without_an_id_are_kept_apart(spark):
    text = " ".join(f"alpha{i}" for i in range(20))
    other = " ".join(f"beta{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, other), (3, "clean words only here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (-1, other), (None, text)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect())
    assert found == [(1, None), (2, -1)]
    got = {r.doc_id: (r.contaminated, list(r["items"])) for r in D.contamination(docs, bench).collect()}
    assert got == {1: (True, []), 2: (True, [-1]), 3: (False, [])}
    assert D.contamination(docs.where("false"), bench).count() == 0
