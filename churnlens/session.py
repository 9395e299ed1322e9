"""Session helpers.

``configure`` sets the runtime options the analyses rely on, without
overriding anything a cluster already decided (for instance a shared
``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime features the plans rely on.  AQE re-plans joins at runtime: it
# broadcasts a side only when its *measured* size is under
# ``autoBroadcastJoinThreshold`` and otherwise keeps the sort-merge join,
# splits skewed join partitions, and coalesces small shuffle partitions.
# They are on by default in Spark 4; ``configure`` turns them on only if a
# session has them switched off, and never touches sizes a cluster chose.
REQUIRED_FEATURES = (
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.coalescePartitions.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
)


def configure(spark: SparkSession) -> SparkSession:
    """Force the UTC session time zone (integer dates and epoch conversions
    are defined in UTC) and make sure the AQE features are on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for key in REQUIRED_FEATURES:
        if str(spark.conf.get(key, "true")).lower() != "true":
            spark.conf.set(key, "true")
    # facts bucketed by subscription join on (account, subscription) as they lie
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "churnlens",
                  event_log_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on).

    ``event_log_dir`` writes Spark's event log there (stage and task times
    for offline reading; no server is started)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only a *local* session without one (tests) gets a scratch
    folder; a cluster session without one is an error, because a
    machine-local folder is not visible to the executors.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        current = tempfile.mkdtemp(prefix="churnlens-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)
