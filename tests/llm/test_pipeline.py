from __future__ import annotations

import importlib

import pytest

import corpus_pipeline
from shotgrid.llm import decontaminate, queries, secret_scan, toxicity
from tests.llm import test_decontaminate, test_near_dedup, test_tokens_packing

SF = "/root/testdata/sf0.001"
NAMES = ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


@pytest.fixture(scope="module")
def kept(spark):
    """The rows each stage returns, as run() chains them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, SF), f"test-{name}")
        assert name == "packing" or docs.columns == columns
        out.append(docs.collect())
    return dict(zip(NAMES, out)) | {"documents": spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(found):
    return sorted(map(tuple, found))


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


def test_stages_equal_brute_force(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out())
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)

    def clean(text):
        words, total = toxicity.fold(text).split(), 0.0
        for i, w in enumerate(words):
            best = max((t for t in model.weights if w.startswith(t)), key=len, default=None)
            around = {" ".join(words[max(0, i - 1):i + 1]), " ".join(words[i:i + 2])}
            total += model.weights[best] if best and not around & set(model.exceptions) else 0.0
        return toxicity.score(model, total, len(text)) < toxicity.THRESHOLD

    assert rows(kept["toxicity"]) == rows(r for r in kept["documents"] if clean(r.text))
    group = test_near_dedup.brute([(r.doc_id, r.text) for r in kept["toxicity"]])
    assert rows(kept["near_dedup"]) == rows(r for r in kept["toxicity"] if group[r.doc_id] == r.doc_id)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in test_decontaminate.brute([(r.doc_id, r.text) for r in kept["near_dedup"]], items)}
    assert leaks and rows(kept["decontamination"]) == rows(r for r in kept["near_dedup"] if r.doc_id not in leaks)
    clean_text = {r.doc_id: r for r in kept["secrets"]}
    assert len(clean_text) == len(kept["decontamination"])
    for r in kept["decontamination"]:
        found = secret_scan.base_spans(r.text)
        assert (r.text == clean_text[r.doc_id].text) or found or secret_scan.REDACTED in clean_text[r.doc_id].text
        for _, end, _, value in found:
            assert r.text[value:end] not in clean_text[r.doc_id].text
        assert clean_text[r.doc_id].n_chars == (r.n_chars if r.text == clean_text[r.doc_id].text else len(clean_text[r.doc_id].text))
    test_tokens_packing.check_pieces(kept["packing"], {r.doc_id: r.text for r in kept["secrets"]})


def test_run_equals_the_chain(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    key = lambda found: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found)
    assert sum(r.length for r in got.collect()) == sum(r.length for r in kept["packing"])
    assert {k[0] for k in key(got.collect())} == {r.doc_id for r in kept["secrets"]}


def test_operators_do_not_hide_import_errors():
    for name in ("common", "queries", "toxicity", "near_dedup", "tokens"):
        module = importlib.import_module(f"shotgrid.llm.{name}")
        assert "except ImportError" not in open(module.__file__).read()
    assert "except ImportError" not in open(corpus_pipeline.__file__).read()
    assert decontaminate.needed(13) == 11 and decontaminate.needed(10) == 8
