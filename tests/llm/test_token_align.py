from __future__ import annotations

import hashlib
import random
from collections import Counter
from functools import lru_cache

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shotgrid.llm import token_align as A

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "▁ x"), (4, "<s> <|endoftext|> </s><unk> <0x41>"), (5, "日本語テキスト\n\n  ab\t é \r\n"),
       (None, "the the the"), (7, "\x00a▁"), (8, "a" * 5000), (9, " lead"), (9, " lead"), (10, "aaaa aaa aa a" * 40),
       (11, "a;\r\n b\t c\u00a0 d \n\n\n"), (12, "\n\nfoo\nbar  baz;\r x"), (13, "it's  we'll\n 's"), (14, " \n ")]


@lru_cache
def token_bytes():
    a = Tokenizer.from_file(public_tokenizers.path(A.BYTE_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.PIECE_FILE))
    names = {i: t for t, i in a.get_vocab().items()}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(x): x for x in plain}
    letter |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return a, b, lambda i: bytes(letter[c] for c in names[i]), piece


def spans(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def brute(rows):
    ta, tb, a_bytes, b_bytes = token_bytes()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        xa, xb = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(xa) != whole or b"".join(xb) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        sa, sb = spans(map(len, xa)), spans(map(len, xb))
        links, low = [], 0
        for i, (s, e) in enumerate(sa):                       # all overlapping pairs
            while sb[low][1] <= s:
                low += 1
            j = low
            while j < len(sb) and sb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        at_a, at_b = {s: i for i, (s, _) in enumerate(sa)}, {s: i for i, (s, _) in enumerate(sb)}
        for cut in cuts:
            na, nb = at_a.get(cut, len(a)), at_b.get(cut, len(b))
            groups.append(",".join(map(str, a[at_a[start]:na])) + "|" + ",".join(map(str, b[at_b[start]:nb])))
            start = cut
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(d, len(a), len(b), len(g), len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, k in docs], counts


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("heavy", [1, 50, A.HEAVY])
def test_odd_texts(spark, heavy):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("pair", F.lit(1))
    assert order(map(tuple, A.align_corpus(docs, heavy=heavy).collect())) == order(brute(ODD)[0])


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, counts = brute(rows)
    assert order(map(tuple, A.align_corpus(docs, heavy=200).collect())) == order(want)
    v = A.vocabularies(A.BYTE_FILE, A.PIECE_FILE)
    got = {r.pair: r.total for r in A.pair_counts(A.alignments(docs)).collect()}
    assert got == {int(v.code(a, b)): n for (a, b), n in counts.items()}


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "hello tokenization")], "doc_id long, text string")
    r = A.alignments(docs).first()
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") + 1 == r.n_groups


def test_units_give_the_whole_texts_tokens():
    v = A.vocabularies(A.BYTE_FILE, A.PIECE_FILE)
    assert v.splits
    rng = random.Random(4)
    letters = ["a", "B", "é", "日", "1", "'", "s", ";", " ", " ", "  ", "\n", "\r", "\t", "\u00a0", "\u3000", "▁", "the", "ing"]
    for _ in range(400):
        text = "".join(rng.choices(letters, k=rng.randint(1, 40)))
        units = A.units_of(text, True)
        assert "".join(units) == " " + text
        whole = A.align(v, [text.encode()], True)
        want = brute([(0, text)])[0][0]
        assert (whole["n_a"][0].as_py(), whole["n_b"][0].as_py(), whole["groups_sha256"][0].as_py()) == (want[1], want[2], want[7])


def test_identity_map_has_same_bytes():
    v = A.vocabularies(A.BYTE_FILE, A.PIECE_FILE)
    found = [(i, b) for i, b in enumerate(v.same.tolist()) if b >= 0]
    assert len(found) > 10_000 and all(v.a_bytes[i] == v.b_bytes[b] for i, b in found)


def test_no_rows(spark):
    assert A.align_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []
