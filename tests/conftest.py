from __future__ import annotations

import json
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from shotgrid.sources.annotations import read_annotations  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("shotgrid-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shotgrid-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def off(t):
    """seconds -> offset record (None stays None)."""
    if t is None:
        return None
    whole = int(t // 1)
    return {"seconds": whole, "nanos": int(round((t - whole) * 1e9))}


def seg(a, b):
    return {"start_time_offset": off(a), "end_time_offset": off(b)}


@pytest.fixture
def docs_from(spark, tmp_path):
    """Write annotation documents as JSON files and read them with the library."""
    counter = {"n": 0}

    def make(*documents, raw_texts=()):
        d = tmp_path / f"docs{counter['n']}"
        counter["n"] += 1
        d.mkdir()
        for i, doc in enumerate(documents):
            (d / f"doc{i}.json").write_text(json.dumps(doc))
        for i, text in enumerate(raw_texts):
            (d / f"raw{i}.json").write_text(text)
        return read_annotations(spark, str(d))

    return make
