"""SparkSession factory and session-level helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: ANSI semantics (errors instead of silent
# nulls), AQE for runtime coalescing / skew-join splitting, UTC clock.
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Additional settings for the ~100 TB / ~1000-executor scale.  Shuffle stages start with many
# partitions and AQE coalesces them to ~256 MB each; scans split files at 256 MB; a partition
# 5x the median and above 512 MB counts as skewed and is split in joins; Arrow batches for
# model plug-ins stay small enough for a model's working memory.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "augsight", extra: dict | None = None,
                profile: str = "local") -> SparkSession:
    """Return (or create) a session with the defaults above.

    On a cluster the master and resources come from spark-submit
    (``profile="cluster"`` adds :data:`CLUSTER_CONF`); locally ``master``
    defaults to ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    # Under spark-submit (a JVM gateway already exists) the master comes from the submit.
    if master:
        builder = builder.master(master)
    elif profile == "local" and "PYSPARK_GATEWAY_PORT" not in os.environ:
        builder = builder.master("local[*]")
    conf = dict(DEFAULT_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    small_batches(spark)
    ship_package(spark)
    return spark


#: Bytes of an Arrow batch, unless the session names another size than Spark's own 64 MB: a plug-in's Python
#: objects take many times its texts.
ARROW_BYTES = "4m"
_ARROW_KEY, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of ``ARROW_BYTES`` for every plug-in, whatever the length of the texts."""
    size = spark.conf.get(_ARROW_KEY).lower()
    if size in (f"{_ARROW_DEFAULT}b", f"{_ARROW_DEFAULT}", "64m", "64mb"):
        spark.conf.set(_ARROW_KEY, ARROW_BYTES)


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per session, so that workers started anywhere import it."""
    sc = spark.sparkContext
    if getattr(sc, "_augsight_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="augsight-src-"), "augsight.zip")  # the driver serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("augsight", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._augsight_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints / intermediate tables.

    Uses ``spark.checkpoint.dir`` from the session (the shared folder a
    cluster names).  Only when it is unset *and* the master is local (tests,
    laptops) does it fall back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="augsight-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; configure a shared (HDFS/S3/DBFS) folder for this cluster")
