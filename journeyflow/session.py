"""Session helpers.

The library needs two things from a session: UTC as the session time zone (all
calendar fields of the journey model are UTC) and adaptive execution with skew
handling, because one journey id may hold a large share of all events.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings the operators rely on. All are settable on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot id even if that costs one more (small, post-partial-agg) shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB",
    # streamed sessions are merged in each task before the shuffle: a hot user sends a row per task and session
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def require_utc(spark: SparkSession) -> SparkSession:
    """Make UTC the session's time zone: calendar fields are wrong in any other. Nothing else is touched."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need; returns the session."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_session(master: str | None = None, partitions: int = 8, app: str = "journeyflow") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's session + tune_session."""
    master = master or os.environ.get("JOURNEYFLOW_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("JOURNEYFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", "10MB")
        .config("spark.sql.files.maxPartitionBytes", "128MB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune_session(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder. Only a local session without one gets a fresh folder; on
    a cluster, where it would not be shared, that is an error."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:  # each call would add a new sub-folder
            spark.sparkContext.setCheckpointDir(current)
        return current
    given = spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="journeyflow-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local
