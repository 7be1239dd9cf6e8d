"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "newsflow",
                  shuffle_partitions: int = 8, conf: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's own builder and
    keep the settings in DEFAULT_CONF."""
    b = SparkSession.builder.master(master or "local[*]").appName(app)
    settings = dict(DEFAULT_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.setdefault("spark.driver.memory", "8g")
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir`` (or a folder already set on the context).
    Only a local-mode session without one gets its own temporary folder;
    a cluster session without the setting is an error, because a
    machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):     # local-cluster has executors
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="newsflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured) if _conf_settable(spark) else None
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def _conf_settable(spark: SparkSession) -> bool:
    try:
        return spark.conf.isModifiable("spark.checkpoint.dir")
    except Exception:  # pragma: no cover - older API
        return False


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never node-local
    on a cluster), for stream sources, sinks and stream checkpoints."""
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def _scratch_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "newsflow-scratch", spark.sparkContext.applicationId)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables this application has written under the shared
    checkpoint folder. Call it when no result that reads them is needed any
    more: results of the library are lazy and may read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside has its shuffle files removed when it ends, for
    results that nothing computes again; else they stay on the executors'
    disks until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df, name: str = "table"):
    """Cut lineage by writing ``df`` as parquet under the session's shared
    checkpoint folder and reading it back: one computation (a reliable
    ``checkpoint()`` of an unpersisted plan computes it twice), survives
    executor loss, and the re-read carries real file sizes for AQE."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Remove the files of a table that ``materialize`` has written and
    nothing reads any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/newsflow-scratch/" not in folder:
            raise ValueError(f"{folder} is no table of materialize()")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
