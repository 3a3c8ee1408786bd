"""SRC-*, SNK-*, UDF-*, STR-*: sources, sinks, scoring and the streaming jobs."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import seg
from shotgrid import schema as S
from shotgrid.operators import chunks, enrich
from shotgrid.sources import annotations as A
from shotgrid.sources import sinks
from shotgrid.streaming import jobs


def test_broken_file_quarantined_f5_p(docs_from):  # F5 p
    good = {"annotation_results": [{"input_uri": "/b/v.mp4", "shot_annotations": [seg(0, 9)]}]}
    scan = docs_from(good, raw_texts=['{"annotation_results": [ broken'])
    assert scan.good.count() == 1
    q = scan.quarantine.collect()
    assert len(q) == 1 and "broken" in q[0].record


def test_missing_results_is_invalid(docs_from):  # FLT-10
    scan = docs_from({"something_else": 1})
    assert scan.good.count() == 0 and scan.quarantine.count() == 1


def test_route_and_retention(spark):
    rows = [("1", "video/mp4", "a/x.mp4", "2024-01-02 00:00:00"),
            ("2", "video/mp4", "a/x.mov", "2024-01-02 00:00:00"),
            ("3", "text/json", "a/x.json", "2023-12-30 00:00:00"),
            ("4", "audio/mp3", "a/x.mp3", "2024-01-02 00:00:00"),
            ("5", "image/png", "a/x.png", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "id string, contentType string, name string, timeCreated string") \
        .withColumn("timeCreated", F.col("timeCreated").cast("timestamp"))
    assert [r.route for r in A.route(df).orderBy("id").collect()] == [
        "video", "unsupported", "json", "audio", "unsupported"]
    kept = sorted(r.id for r in A.retained(df, "2024-01-02 12:00:00").collect())
    assert kept == ["1", "2", "4", "5"]


def test_object_inventory_prunes_content(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x" * 10)
    inv = A.object_inventory(spark, str(tmp_path), "*.mp4")
    assert inv.columns == ["path", "length", "modificationTime"]
    assert [r.length for r in inv.collect()] == [10]
    assert "content" not in inv._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_sinks_text_and_typed(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, None)], "index int, time_start double, description string")
    path = str(tmp_path / "t")
    sinks.save_text(df, path)
    back = spark.read.parquet(path)
    assert dict(back.dtypes) == {"index": "string", "time_start": "string", "description": "string"}
    assert back.first().description is None
    assert sinks.as_text(df, null_as="None").first().description == "None"
    typed = sinks.typed(back, "index INT, time_start DOUBLE, extra STRING")
    r = typed.first()
    assert (r["index"], r.time_start, r.extra) == (1, 2.5, None)


def test_score_failover_and_errors(spark):
    calls = []

    def model(text, endpoint):
        calls.append(endpoint)
        if text == "quota" and endpoint == "r1":
            raise enrich.Retryable("quota")
        if text == "bad":
            raise ValueError("broken input")
        if text == "err":
            return "ERROR"
        return text.upper()

    df = spark.createDataFrame([("ok",), ("quota",), ("bad",), ("err",)], "t string")
    got = {r.t: r for r in enrich.score(df, model, "t", endpoints=["r1", "r2"], max_passes=2).collect()}
    assert got["ok"].result == "OK" and got["ok"].endpoint == "r1" and got["ok"].attempts == 1
    assert got["quota"].result == "QUOTA" and got["quota"].endpoint == "r2"
    assert got["bad"].result == "ERROR: broken input" and got["bad"].attempts == 2
    assert got["err"].error is not None and got["err"].attempts == 4


def test_score_rules_of_the_reference(spark):
    calls = {}

    def model(text, endpoint):
        n = calls[text] = calls.get(text, 0) + 1
        if text == "fenced":                      # a fenced ERROR is an ERROR
            return "```json ERROR```".replace(" ", "")
        if text == "reset":                       # a later ERROR answer keeps the loop going
            if n < 3:
                if endpoint == "r1":
                    raise ValueError("hard")
                return "ERROR"
            return "fine"
        return iter(["it's ", "```json", " joined"])

    run = lambda t: enrich._call_with_failover(
        model, t, ["r1", "r2"], 3, lambda e: isinstance(e, enrich.Retryable), 0.0, {})
    assert run("fenced") == ("ERROR: ", "", 6, None)
    assert run("reset") == ("fine", None, 3, "r1")
    assert run("parts") == ('it"s  joined', None, 1, "r1")
    enrich.register_model("shout", lambda v, ep, mark: v.upper() + mark, mark="!")
    df = spark.createDataFrame([("a",)], "t string")
    assert enrich.score_by_name(df, "shout", "t").first().result == "A!"
    assert enrich.score_by_name(df, "shout", "t", mark="?").first().result == "A?"


def test_half_broken_json_is_quarantined_by_both_readers(spark, tmp_path):
    good = json.dumps({"annotation_results": [{"input_uri": "/b/v.mp4", "shot_annotations": [seg(0, 9)]}]})
    half = good.replace('"seconds": 9', '"seconds": "x5"')
    assert half != good
    texts = [good, half, good[:-3], '{"other": 1}']
    (tmp_path / "d.json").write_text("\n".join(texts))
    read = A.read_annotations(spark, str(tmp_path), multi_line=False)
    parsed = A.parse_annotations(spark.createDataFrame([("f", t) for t in texts], "file string, value string"))
    for scan in (read, parsed):
        assert scan.good.count() == 1 and scan.quarantine.count() == 3
    assert {r.record for r in parsed.quarantine.collect()} == set(texts[1:])
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_json_overlay_tags_win(spark):
    df = spark.createDataFrame([('{"a": "1", "b": "2"}',)], "j string") \
        .withColumn("tags", F.create_map(F.lit("b"), F.lit("tag")))
    props = enrich.json_overlay(df, "j", "tags").first().props
    assert props == {"a": "1", "b": "tag"}


def write_doc(d, name, shots):
    doc = {"annotation_results": [{"input_uri": f"/b/{name}.mp4",
                                   "shot_annotations": [seg(a, b) for a, b in shots]}]}
    with open(os.path.join(d, f"{name}.json"), "w") as fh:
        json.dump(doc, fh)


def test_stream_equals_batch(spark, tmp_path):  # STR-2, two availableNow rounds
    inp = tmp_path / "in"
    inp.mkdir()
    out, ckpt = str(tmp_path / "out"), str(tmp_path / f"ckpt-{uuid.uuid4().hex}")
    write_doc(inp, "v1", [(0, 2), (2, 9), (9, 10)])
    (inp / "broken.json").write_text("{ not json")
    jobs.start_annotation_job(spark, str(inp), out, ckpt, 5.0, max_file_age=None).awaitTermination()
    write_doc(inp, "v2", [(0, 6), (6, 20)])
    jobs.start_annotation_job(spark, str(inp), out, ckpt, 5.0, max_file_age=None).awaitTermination()
    streamed = sorted((r.video_source, r["index"], r.time_start, r.time_stop)
                      for r in spark.read.parquet(f"{out}/chunks").collect())
    batch = A.read_annotations(spark, str(inp)).good
    expected = sorted((r.video_source, r["index"], r.time_start, r.time_stop)
                      for r in chunks.chunk_manifest(chunks.min_duration_chunks(batch, 5.0)).collect())
    assert streamed == expected and len(expected) == 3
    assert spark.read.parquet(f"{out}/quarantine").count() == 1  # quarantined once


def test_request_job_stream(spark, tmp_path):  # STR-1
    arr = tmp_path / "arrivals"
    arr.mkdir()
    events = [{"id": "1", "bucket": "in", "name": "fr-FR/clip.mp4", "contentType": "video/mp4"},
              {"id": "2", "bucket": "in", "name": "x.json", "contentType": "application/json"},
              {"id": "3", "bucket": "in", "name": "clip2.mov", "contentType": "video/mp4"}]
    (arr / "e.json").write_text("\n".join(json.dumps(e) for e in events))
    out, ckpt = str(tmp_path / "req"), str(tmp_path / "req-ckpt")
    jobs.start_request_job(spark, str(arr), out, ckpt, "work", "1.0",
                           ["SHOT_CHANGE_DETECTION", "LABEL_DETECTION"]).awaitTermination()
    rows = sorted((r.input_uri, r.feature, r.output_uri) for r in spark.read.parquet(out).collect())
    assert rows == [
        ("gs://in/fr-FR/clip.mp4", "LABEL_DETECTION", "gs://work/fr-FR/LABEL_DETECTION/clip - 1.0.json"),
        ("gs://in/fr-FR/clip.mp4", "SHOT_CHANGE_DETECTION",
         "gs://work/fr-FR/SHOT_CHANGE_DETECTION/clip - 1.0.json")]


def test_classify_job_stream(spark, tmp_path):  # STR-3
    manifest_dir, calls = tmp_path / "manifest", tmp_path / "calls"
    calls.mkdir()
    rows = [("gs://o/CSA/v/chunks - 1.mp4",), ("gs://o/CSA/v/chunks - 2.mp4",),
            ("gs://o/CSA/v/chunks - 1.json",)]
    spark.createDataFrame(rows, "object_name string").write.parquet(str(manifest_dir))
    tags = spark.createDataFrame([("gs://o/CSA/v/chunks - 1.mp4", "v", "1", "0.5", "2.5")],
                                 "uri string, video_blobname string, index string, time_start string, time_stop string")
    folder = str(calls)

    def model(name, endpoint):
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if name.endswith("2.mp4"):
            raise ValueError("cannot read")
        return "a description"

    def embed(context, endpoint):
        return [(0.0, 1.0, [float(len(context)), 2.0])]

    out, ckpt = str(tmp_path / "cls"), str(tmp_path / "cls-ckpt")
    jobs.start_classify_job(spark, str(manifest_dir), tags, out, ckpt, model, ["r1"],
                            "object_name string", embed=embed, run_ts="2024-01-01 00:00:00").awaitTermination()
    assert len(os.listdir(folder)) == 2  # once for each chunk, whatever is written
    res = spark.read.parquet(f"{out}/results").collect()
    assert [(r.uri, r.description, r.update_time) for r in res] == [
        ("gs://o/CSA/v/chunks - 1.mp4", "a description", "2024-01-01 00:00:00")]
    fails = spark.read.parquet(f"{out}/failures").collect()
    assert [(r.uri, r.description) for r in fails] == [("gs://o/CSA/v/chunks - 2.mp4", "ERROR: cannot read")]
    texts = sorted((r.name, r.text) for r in spark.read.parquet(f"{out}/texts").collect())
    assert texts == [("gs://o/CSA/v/chunks - 1.json", "a description"), ("gs://o/CSA/v/chunks - 2.json", "ERROR: cannot read")]
    emb = spark.read.parquet(f"{out}/embeddings").collect()
    assert [(r.description, r["index"], r.start, r.stop, r.embeddings) for r in emb] == [
        ("a description", 1, 0.0, 1.0, [13.0, 2.0])]  # only the tagged chunk
    jobs.start_classify_job(spark, str(manifest_dir), tags, out, str(tmp_path / "second"), model, ["r1"],
                            "object_name string").awaitTermination()
    assert spark.read.parquet(f"{out}/results").count() == 2  # a fresh checkpoint keeps the old output


def test_tags_added_after_the_start_are_used(spark, tmp_path):  # STR-3, JN-1
    manifest, tags = tmp_path / "manifest", tmp_path / "tags"
    out, ckpt = str(tmp_path / "cls"), str(tmp_path / "ckpt")

    def chunk(n):
        spark.createDataFrame([(f"gs://o/v/chunks - {n}.mp4",)], "object_name string").coalesce(1).write.mode("append") \
            .parquet(str(manifest))

    def tag(n):
        spark.createDataFrame([(f"gs://o/v/chunks - {n}.mp4", "s", "v", str(n), "0.0", "2.0")], S.TAGS).coalesce(1) \
            .write.mode("append").parquet(str(tags))

    def run():
        jobs.start_classify_job(spark, str(manifest), str(tags), out, ckpt, lambda v, ep: "text of " + v[-5], ["r"],
                                "object_name string", run_ts="2024-01-01 00:00:00").awaitTermination()
        return sorted((r.uri[-5], r.description) for r in spark.read.parquet(f"{out}/results").collect())

    chunk(1), chunk(2), tag(1)
    assert run() == [("1", "text of 1")]
    tag(2), tag(3)          # after the job's start, the first of them for a chunk of the batch before
    chunk(3)
    assert run() == [(n, f"text of {n}") for n in ("1", "2", "3")]
    chunk(4)
    assert run() == [(n, f"text of {n}") for n in ("1", "2", "3")]       # nothing twice, and 4 waits
    left = max((tmp_path / "cls" / "_untagged").glob("run=*/batch_id=*"), key=lambda p: int(p.name.split("=")[1]))
    assert [r.uri[-5] for r in spark.read.parquet(str(left)).collect()] == ["4"]


def test_intermediates_expire(spark, tmp_path):  # STR-4
    old, live, last = (tmp_path / "_scored" / "run=a" / f"batch_id={n}" for n in (2, 10, 11))
    alone = tmp_path / "_parsed" / "run=b" / "batch_id=0"
    for p in (old, live, last, alone, tmp_path / "results" / "run=a" / "batch_id=2"):
        spark.range(3).write.parquet(str(p))
    now = os.path.getmtime(live)
    for p in (old, alone, tmp_path / "results" / "run=a" / "batch_id=2", last):
        for f in p.iterdir():
            os.utime(f, (now - 2 * 86400, now - 2 * 86400))
    gone = jobs.expire_intermediates(spark, str(tmp_path))
    assert [g.split("/")[-3:] for g in gone] == [["_scored", "run=a", "batch_id=2"]] and not old.exists()
    assert live.exists() and last.exists() and alone.exists() and (tmp_path / "results" / "run=a" / "batch_id=2").exists()


def test_old_files_are_read_and_outputs_guarded(spark, tmp_path):  # STR-2, STR-4
    inp = tmp_path / "in"
    inp.mkdir()
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    write_doc(inp, "v1", [(0, 2), (2, 9)])
    jobs.start_annotation_job(spark, str(inp), out, ckpt, 5.0).awaitTermination()
    write_doc(inp, "late", [(0, 6), (6, 20)])
    two_days = os.path.getmtime(inp / "v1.json") - 2 * 86400
    os.utime(inp / "late.json", (two_days, two_days))

    def outputs(good, min_seconds):
        def fail():
            raise RuntimeError("the cutter broke")
        return jobs.annotation_outputs(good, min_seconds) | {"chunks": fail}

    jobs.start_annotation_job(spark, str(inp), out, ckpt, 5.0, outputs=outputs).awaitTermination()
    assert spark.read.parquet(f"{out}/chunks").count() == 1
    errors = spark.read.parquet(f"{out}/errors").collect()
    assert [(e.output, e.error) for e in errors] == [("chunks", "the cutter broke")]
    for table in ("explicit", "ocr", "labels"):
        assert len(os.listdir(next((tmp_path / "out" / table).glob("run=*")))) == 2
    assert spark.read.parquet(f"{out}/_parsed").count() == 2  # the late file was read


def test_reduced_read_schema(spark, tmp_path):  # SRC-1 with a narrowed JSON schema
    doc = {"annotation_results": [{"input_uri": "/b/v.mp4", "shot_annotations": [seg(0, 9)],
                                   "text_annotations": [{"text": "x"}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    scan = A.read_annotations(spark, str(tmp_path), features=["shot_annotations"])
    fields = scan.good.schema["annotation_results"].dataType.elementType.fieldNames()
    assert fields == ["input_uri", "segment", "shot_annotations"]
    assert chunks.min_duration_chunks(scan.good, 5.0).count() == 1


def test_embedding_inputs_precondition(spark):  # UDF-6
    import pytest as _pytest
    df = spark.createDataFrame([("a", None), (None, "gs://b/i.png"), (None, None)],
                               "text string, image_uri string")
    assert enrich.embedding_inputs(df, strict=False).count() == 2
    with _pytest.raises(Exception, match="needs a text or an image"):
        enrich.embedding_inputs(df).collect()


def test_text_beside_source(spark, tmp_path):  # SNK-4
    df = spark.createDataFrame([("CSA/v.mp4/chunks - 1.mp4", "desc")], "name string, text string")
    out = sinks.text_beside_source(df, "name")
    assert out.first().target_name == "CSA/v.mp4/chunks - 1.json"
    sinks.write_texts(out, str(tmp_path / "texts"))
    assert spark.read.parquet(str(tmp_path / "texts")).first().name == "CSA/v.mp4/chunks - 1.json"


def test_typed_sinks_and_helpers(spark, tmp_path):  # SNK-2, SNK-3, SNK-5, SNK-6, UDF-3, SCL-9
    emb = spark.createDataFrame([("gs://in/a.mp4", "d", [1.0, 2.0], "3", "0.5", "1.5")],
                                "video_source string, description string, embeddings array<float>, "
                                "index string, start string, stop string")
    sinks.save_embeddings(emb, str(tmp_path / "emb"))
    sinks.save_embeddings(emb, str(tmp_path / "emb"), truncate=True)
    back = spark.read.parquet(str(tmp_path / "emb"))
    assert back.count() == 1 and dict(back.dtypes)["embeddings"] == "array<double>"
    assert dict(back.dtypes)["index"] == "int" and back.first().start == 0.5
    res = spark.createDataFrame([("7", "1.0", "2.0", "v", "s", "d", "t", "u")],
                                "index string, time_start string, time_stop string, video_blobname string, "
                                "video_source string, description string, update_time string, uri string")
    sinks.save_results_typed(res, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).first()["index"] == 7
    sinks.write_manifest(res, str(tmp_path / "man"))
    assert len(sinks.to_client(spark.read.parquet(str(tmp_path / "man")), 5)) == 1
    ans = spark.createDataFrame([("```json {'ok': 'yes'} ```", "x" * 1100)], "result string, description string")
    parsed = enrich.clean_answer(ans, ddl="ok STRING").first().parsed
    assert parsed.ok == "yes"
    assert len(enrich.embedding_requests(ans).first().context) == 1000


def test_replayed_batch_is_idempotent(spark, tmp_path):  # STR-5
    inp = tmp_path / "in"
    inp.mkdir()
    write_doc(inp, "v1", [(0, 2), (2, 9), (9, 16)])
    batch = spark.read.schema(A.S.annotation_schema(A.CORRUPT)).option("multiLine", True) \
        .option("columnNameOfCorruptRecord", A.CORRUPT).json(str(inp)) \
        .select(F.col("_metadata.file_path").alias("file"), "annotation_results", A.CORRUPT)
    out = str(tmp_path / "out")
    run = jobs.annotation_batch(out, 5.0)
    run(batch, 7)
    first = sorted(tuple(r) for r in spark.read.parquet(f"{out}/chunks").collect())
    run(batch, 7)  # the same micro-batch delivered again
    again = sorted(tuple(r) for r in spark.read.parquet(f"{out}/chunks").collect())
    assert first == again and len(first) == 2


def _counted(folder, stop_at=None):
    """A model that notes every call; its worker dies once at ``stop_at``."""
    def model(value, endpoint):
        marker = os.path.join(folder, "stopped")
        if value == stop_at and not os.path.exists(marker):
            open(marker, "w").close()
            os._exit(1)
        with open(os.path.join(folder, f"{value}-{uuid.uuid4().hex}"), "w"):
            pass
        if value.startswith("bad") and not os.path.exists(os.path.join(folder, "mended")):
            raise ValueError("broken")
        return value.upper()
    return model


def _calls(folder):
    return [n.rsplit("-", 1)[0] for n in os.listdir(folder) if "-" in n]


def test_a_stopped_run_pays_for_one_group_again(spark, tmp_path):  # UDF-1
    folder, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    names = [f"v{n:02}" for n in range(20)]
    order = sorted(names, key=lambda n: hashlib.sha256(n.encode()).hexdigest())
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place int")
    run = lambda: enrich.score_once(df, _counted(str(folder), "v13"), "name", ledger, partitions=1, group=4)
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of the dead worker
        run().collect()
    first = _calls(folder)
    assert sorted(first) == sorted(order[:order.index("v13")])        # whole groups, and some calls of the next
    assert sorted((r.name, r.place, r.result) for r in run().collect()) == [(n, i, n.upper()) for i, n in enumerate(names)]
    again = order[len(first) // 4 * 4:len(first)]
    assert sorted(_calls(folder)) == sorted(names + again) and len(again) < 4   # only the unfinished group's calls
    run().collect()
    assert len(_calls(folder)) == len(names + again)                  # all is filed


def test_ledger_of_failures_repeats_and_nulls(spark, tmp_path):  # UDF-1
    folder, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    df = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "name string")
    run = lambda: sorted((str(r.name), r.result, r.error, r.attempts, r.endpoint) for r in enrich.score_once(
        df, _counted(str(folder)), "name", ledger).collect())
    good, none = ("a", "A", None, 1, "default"), ("None", "ERROR: no input", "no input", 0, None)
    assert run() == [none, good, good, ("bad", "ERROR: broken", "broken", 1, None)]
    assert sorted(_calls(folder)) == ["a", "bad"]
    (folder / "mended").touch()
    assert run() == [none, good, good, ("bad", "BAD", None, 1, "default")]   # a failure is tried again
    assert sorted(_calls(folder)) == ["a", "bad", "bad"]
    empty = enrich.score_once(df.limit(0), _counted(str(folder)), "name", str(tmp_path / "other"))
    assert empty.columns == ["name", "result", "error", "attempts", "endpoint"] and empty.count() == 0


def test_ledger_of_embeddings(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "name string")
    got = enrich.score_once(df, lambda v, ep: [(0.0, 1.0, [0.5, 2.0])], "name", str(tmp_path / "ledger"),
                            result_type=enrich.EMBEDDING_RESPONSE).first()
    assert [tuple(s) for s in got.result] == [(0.0, 1.0, [0.5, 2.0])]
