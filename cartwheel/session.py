"""Session construction and cluster-wide settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every cartwheel job relies on. AQE re-plans joins from measured stage sizes,
# splits skewed join partitions and coalesces small shuffle partitions. Broadcasts are
# decided only on *measured* sizes: the planner's estimate-based broadcast is off, AQE's
# runtime one (after the small side's shuffle stage has materialised) is on. Operators add
# an explicit broadcast hint only for sides whose size is fixed by construction (a global
# aggregate's single row, one row per column).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoint files (bounded_broadcast) are removed once their frame is garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Call-site capture for error messages costs a JVM round trip per Column function.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "cartwheel",
                  shuffle_partitions: int | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above.

    ``master`` and ``shuffle_partitions`` are only set when given, so a cluster launcher's own
    values win.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    Taken from the running context or ``spark.checkpoint.dir``. Where neither is set, a local
    master (tests) gets a private folder; any other master is refused, as its executors
    would each write to a disk of their own.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="cartwheel-ckpt-")
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for a written intermediate table; it is removed at
    the end of the innermost ``scratch.scratch_scope``, else of the session."""
    from cartwheel import scratch
    return scratch.scratch_path(spark, name)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the file system that holds it."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def cluster_conf(shuffle_bytes: float, *, cores: int, target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Suggested settings for a job whose largest shuffle moves about ``shuffle_bytes``.

    Start with enough shuffle partitions that each holds ~``target_partition_bytes`` (and at
    least 3 per core); AQE then coalesces the small ones and splits skewed ones, so erring
    high is cheap. Example: 20 TB shuffled on 1000 executors x 8 cores -> 160 000 partitions.
    """
    partitions = max(int(shuffle_bytes // target_partition_bytes) + 1, 3 * cores)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
    }
