"""Session helpers: a sane local builder and the shared scratch location."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "shotgrid") -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used as is."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh directory under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names storage every executor can reach; it is
    read from the session. Only a local session may go without: there a scratch
    folder is chosen, registered, and removed at exit. Elsewhere executors would
    write to their own disks, so an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not base and sc is not None:
        base = sc.getCheckpointDir()
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shotgrid-ckpt-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
        if sc is not None:
            sc.setCheckpointDir(base)
    path = "/".join([base.rstrip("/"), "shotgrid", *parts, uuid.uuid4().hex])
    return path


def store(df, name: str):
    """Write a DataFrame once to the shared folder and read it back (cuts lineage); it goes when the application ends."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system remove ``path`` when the application ends."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def file_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: changes when the table does."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(jpath) if fs.exists(jpath) else []
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


ARROW_BATCH_BYTES = 16 << 20  # of one Arrow batch handed to a Python worker


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, however large single rows are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) != f"{ARROW_BATCH_BYTES}b":
        spark.conf.set(key, f"{ARROW_BATCH_BYTES}b")


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        return None


def session_id(spark: SparkSession) -> str:
    sc = _context(spark)
    if sc is not None:
        return sc.applicationId
    return spark.conf.get("spark.app.id", None) or str(id(spark))
