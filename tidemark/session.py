"""Session construction and the shared scratch location.

On a cluster the scratch location is the shared folder named by
``spark.checkpoint.dir``; we only set one ourselves when the session has none
(tests, local runs).  Nothing is ever written to a machine-local temp folder
behind the cluster's back.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session defaults tuned for the scan → aggregate shapes of this engine.
# AQE re-plans joins to broadcast when a side turns out small at runtime,
# coalesces tiny shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Catalyst/AQE only broadcast sides whose estimated/measured size is below this (the
    # Spark default, kept explicit: every broadcast is built on the driver).
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # AQE sizes post-shuffle partitions to ~128 MB and splits skewed ones (> 5× median, > 256 MB).
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
}
# Only for local[N] runs: few shuffle partitions (AQE coalesces further). On a cluster the
# shuffle partition count is left to the cluster's configuration (sized for the data: at
# 100 TB, thousands of partitions of ~128 MB) and AQE coalesces/splits at runtime.
LOCAL_CONF = {"spark.sql.shuffle.partitions": "8"}


def get_spark(master: str | None = None, app: str = "tidemark", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = (master or "").startswith("local")
    for k, v in {**DEFAULT_CONF, **(LOCAL_CONF if local else {}), **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    Only a local[N] session without one gets a fresh local folder (tests, local runs); a
    cluster session without a shared checkpoint folder is an error, never a silent local
    temp folder on the driver."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    path = os.path.join(base, "tidemark", f"{name}-{uuid.uuid4().hex[:12]}")
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem (works on shared cluster storage)."""
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Child names of a directory through the Hadoop FileSystem ([] when missing)."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the library's own through the Hadoop FileSystem."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def rename_path(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if the target is there already."""
    p, fs = _fs(spark, source)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return not fs.exists(to) and bool(fs.rename(p, to))


def file_states(spark: SparkSession, path: str) -> list[str]:
    """"path size time of change" of a file, or of all files below a folder, sorted."""
    p, fs = _fs(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sorted(found)
