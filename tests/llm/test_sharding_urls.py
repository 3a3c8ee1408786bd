from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from shotgrid.llm import sharding, url_filter as U

SF = "/root/testdata/sf0.01"


def cost(key, i, w):
    h = xxhash.xxh64_intdigest(f"{key}:{i}".encode(), seed=42)
    return -math.log(((h >> 11) + 0.5) / (1 << 53)) / w


def test_shards_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(text)
    slots = defaultdict(list)
    for r in rows:
        best = min((cost(r.doc_id, i, 1.0), i) for i in range(24))
        assert (r.shard, r.grown_shard) == (best[1], 24 if cost(r.doc_id, 24, 1.0) < best[0] else best[1])
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(24)) and 10 < sum(r.grown_shard == 24 for r in rows) < 90


def test_weights_give_proportions(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r.shard for r in sharding.shard(docs, (1.0, 2.0, 5.0)).collect())
    assert n[0] == pytest.approx(2500, rel=0.1) and n[1] == pytest.approx(5000, rel=0.1)
    with pytest.raises(ValueError):
        sharding.shard(docs, (1.0, 0.0))


def test_sharding_defined_cases(documents):
    rows = [(1, None), (1, None), (None, "é"), (None, ""), (2, "x" * 300_000)]
    docs = documents(*rows).withColumn("shard", F.lit("clash")).withColumn("size", F.lit("x")).withColumn("range", F.lit(1))
    got = sharding.shard(docs).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        [(1, 8, 0)] * 2 + [(0, 10, zlib.crc32("é".encode())), (0, 8, 0), (2, 300_008, zlib.crc32(b"x" * 300_000))])
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in got}) == len(rows)
    assert sharding.shard(docs.where("false")).count() == 0


def parts(url):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def grams(text):
    t = "^^" + text + "^"
    return [t[i:i + 3] for i in range(len(t) - 2)]


def fold(host, path):
    return re.sub(r"[^a-z0./_\-]", "~", re.sub("[1-9]", "0", re.sub("[A-Z]", lambda x: x[0].lower(), host + path)))


class Markov:
    def __init__(self, texts):
        self.n = [Counter(), Counter(), Counter()]
        for t in texts:
            for g in grams(t):
                for k in range(3):
                    self.n[k][g[2 - k:]] += 1

    def p(self, g):
        p = 1 / len(U.ALPHABET)
        for k in range(3):
            context, level = g[2 - k:2], self.n[k]
            seen = [v for x, v in level.items() if x[:-1] == context]
            total, kinds = sum(seen), len(seen)
            kinds = max(kinds, 1) if k else kinds
            p = (level[g[2 - k:]] + kinds * p) / max(total + kinds, 1) if total + kinds else p
        return p


def test_urls_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").union(spark.createDataFrame(
        [(-1, "http://WWW.Example.COM/en/x"), (-2, "http://example.com"), (-3, "https://a.net/es/?q"), (-4, "ftp://x.www.example.com/en/#t"),
         (-5, "http://notexample.com/en/"), (-6, "x://com/a"), (-7, "http://a://b.net/fr/1"), (-8, "http://É.NET/FR/\nx")], "page_id long, url string"))
    source = {r.page_id: r.url for r in pages.collect()}
    got = U.judge(pages).collect()
    assert len(got) == len(source)
    ruled = defaultdict(list)
    for i, url in source.items():
        if fit := rule(*parts(url)):
            ruled[fit[0]].append(fold(*parts(url)))
    good, bad = Markov(ruled["allow"]), Markov(ruled["block"])
    limit = None
    for r in got:
        host, path = parts(source[r.page_id])
        assert (r.host, r.path) == (host, path)
        fit = rule(host, path)
        assert r.rule == (fit[1] + fit[2] if fit else None)
        if fit:
            assert r.verdict == fit[0] and r.score is None
        else:
            g = grams(fold(host, path))
            want = sum(math.log(good.p(x)) - math.log(bad.p(x)) for x in g) / len(g)
            assert r.score == pytest.approx(want, abs=1e-9)
            limit = max(limit or -99, want) if r.verdict == "block" else limit
    assert all(r.score > (limit or -99) - 1e-9 for r in got if r.rule is None and r.verdict == "allow")


def test_url_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (None, "http://a.org/x"), (4, "http://b.com/x"), (4, "http://b.com/x"),
            (5, "http://c.net/es/" + "y" * 50_000), (6, "http://q.org/" + "z" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("x"))
    got = U.judge(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and (by[1].host, by[1].path, by[1].rule) == ("", "", None) == (by[3].host, by[3].path, by[3].rule)
    assert by[4].verdict == "allow" and by[5].verdict == "block" and {r.verdict for r in got} <= {"allow", "block"}
    assert U.judge(pages.where("false")).count() == 0
    assert {r.verdict for r in U.judge(pages.where("page_id in (1, 4, 6)")).collect()} == {"allow"}


def test_equal_rows_are_dealt_over_many_ranges(spark, documents, monkeypatch):
    written = []
    monkeypatch.setattr(sharding, "stash", lambda df, name, put=sharding.stash: written.append(put(df, name)) or written[-1])
    rows = documents(*[(7, "hot")] * 4000, *[(100 + i, "cold") for i in range(4000)]).repartition(4)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"     # so few rows would be one range again
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        got = sharding.shard(rows).collect()
    finally:
        spark.conf.set(coalesce, before)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 8000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    dealt = [r["count"] for r in written[-1].where("doc_id = 7").groupBy("range").count().collect()]
    assert sum(dealt) == 4000 and max(dealt) <= 2000
