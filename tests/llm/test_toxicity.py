from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from shotgrid.llm import toxicity as T

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return T.fit(docs, labels.where(~T.held_out()))


def test_fold_maps_look_alikes_digits_and_marks():
    assert T.fold("1D10T").split() == T.fold("idiot").split()
    assert T.fold("іdіоt").split() == T.fold("Idiot!").split()[:1] or T.fold("іdіоt").split() == ["idiot"]
    assert T.fold("l0ser").split() == T.fold("LOSER").split() == T.fold("ｌｏｓｅｒ").split()
    assert T.fold("a​b").split() == ["ab"]


def test_hits_equal_brute_force_and_exceptions_cancel():
    m = T.Model({"idiot": 2.0, "idiotic": 3.0, "scum": 1.0}, ["pond scum"])
    auto = m.automaton()

    def brute(text):
        words, out = T.fold(text).split(), 0.0
        for i, w in enumerate(words):
            best = max((t for t in m.weights if w.startswith(t)), key=len, default=None)
            if best and not (w == "scum" and i and words[i - 1] == "pond"):
                out += m.weights[best]
        return out

    for text in ("", "idiot idiots idiotic", "pond scum scum", "scumpond scum pond", "ascum", "Pond SCUM, idi0ts"):
        assert T.hits(auto, T.fold(text))[0] == brute(text), text


def test_held_out_rows_are_never_learned_from(spark):
    ids = [r.doc_id for r in spark.range(200).toDF("doc_id").where(T.held_out()).collect()]
    assert ids == [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]


def test_held_out_accuracy(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = T.toxicity(docs, model).join(labels, "doc_id").where(T.held_out()).collect()
    hit = sum(r.predicted == r.toxic for r in rows)
    assert hit >= 0.98 * len(rows)
    good = [r.score for r in rows if r.toxic]
    rest = [r.score for r in rows if not r.toxic]
    auc = sum((g > x) + 0.5 * (g == x) for g in good for x in rest) / len(good) / len(rest)
    assert auc > 0.95


def test_defined_cases(documents, model, spark):
    bad = max(model.weights, key=model.weights.get)
    rows = [(1, None), (2, ""), (3, "... --"), (4, f"{bad} " * 5), (4, f"{bad} " * 5), (None, "fine words"),
            (5, "word " * 200_000)]
    docs = documents(*rows).withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("x"))
    got = T.toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score and by[4].predicted == 1 and by[5].predicted == 0
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 5}
    assert T.toxicity(docs.where("false"), model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = T.fit(docs, nothing)
    assert not empty.weights and {r.score for r in T.toxicity(docs, empty).collect()} == {0.0}


def test_a_small_lexicon_keeps_the_strongest_entries():
    terms = {"aaa": (3.0, 5), "bbb": (3.1, 5), "zzzz": (6.0, 90), "yyyyyy": (5.0, 80)}
    assert T.lexicon(terms, 2) == {"zzzz": 6.0, "yyyyyy": 5.0}
    assert T.lexicon(terms) == {t: w for t, (w, _) in terms.items()}
