from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from shotgrid.llm import merkle as M

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    n = r["n_chars"] + more if r["n_chars"] is not None else None
    values = (r["doc_id"], r["source"], r["lang"], n, r["text"])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, place, digest):
    """(siblings, root) from ``digest`` in the place of a leaf."""
    found = []
    for nodes in tree[:-1]:
        run = nodes[place // 2 * 2:place // 2 * 2 + 2]
        own = place % 2
        found += [d for k, d in enumerate(run) if k != own]
        run[own] = digest
        digest, place = h(*run), place // 2
    return found, digest


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[g]]) for g in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for i, g in enumerate(names):
        for j, r in enumerate(groups[g]):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            low, sub = climb(trees[i], j, leaf(r, int(bad)))
            high, folded = climb(top, i, sub)
            out.append((r["doc_id"], leaf(r), trees[i][-1][0], top[-1][0], h(*low, *high), folded, folded == top[-1][0]))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def check(docs, height=M.HEIGHT):
    got = [tuple(r) for r in M.verified(M.prove(docs, height=height)).collect()]
    want = brute([r.asDict() for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert order(got) == order(want)


def test_manifest_equals_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("height", [1, 3])
def test_many_rounds_give_the_same(spark, height):
    rows = [(i * 7 % 101, "t" * (i % 5), "en" if i % 3 else "fr", None, i) for i in range(101)]
    check(spark.createDataFrame(rows, SCHEMA), height)


def test_defined_cases(spark):
    rows = [(1, "a", "en", "s", 1)] * 3 + [(1, "b", "en", "s", 1), (None, None, None, None, None), (2, "é", "é", "s", None),
                                           (-3, "", "", None, 0), (5, "x" * 300_000, "en", "s", 9)]
    rows += [(7, "hot", "hot", "s", 3)] * 40
    check(spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("clash")).withColumn("grp", F.lit(1)))
    check(spark.createDataFrame(rows[:1], SCHEMA))
    assert M.verified(M.prove(spark.createDataFrame([], SCHEMA))).collect() == []


def test_more_groups_than_a_block_holds(spark):
    rows = [(i, "x", f"g{i % 37:02d}", "s", i) for i in range(90)]
    check(spark.createDataFrame(rows, SCHEMA), 2)


def test_proof_is_checked_from_the_parts(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(6)], SCHEMA)
    r = M.prove(rows).where("doc_id = 4").first()
    digest = r.leaf
    for step in r.proof:
        digest = h(digest) if not step else h(step[1:], digest) if step[0] == "L" else h(digest, step[1:])
    assert digest == r.root == r.subroot and len(r.proof) == 3


def test_queue_takes_labels_in_order():
    nodes = M.raise_block(8, ["a", "b", "c"], 3)
    assert nodes[1, 4] == h("ab") and nodes[1, 5] == h("c") and nodes[2, 2] == h(nodes[1, 4], nodes[1, 5])
    assert nodes[3, 1] == h(nodes[2, 2]) and len(nodes) == 7
