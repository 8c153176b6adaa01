"""Session construction and shared scratch locations.

On a cluster the session is created by the platform; ``get_spark`` only fills in settings that
are unset, so a cluster's own ``spark.checkpoint.dir`` and sizing always win.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults for local runs and tests. Cluster deployments override these through spark-submit.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # sessions of a key are merged inside tasks before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Starting points for a large cluster (about 1000 executors reading ~100 TB of parquet).
# AQE sizes shuffles at run time: start from many shuffle partitions and let it coalesce to the
# advisory size, split skewed partitions, and convert joins to broadcast only when the measured
# side is under the threshold.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(app: str = "txmon", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None, cluster: bool = False) -> SparkSession:
    """A session with the library's defaults; ``cluster`` adds ``CLUSTER_CONF`` (RocksDB state, large shuffles)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = _DEFAULTS | (CLUSTER_CONF if cluster else {})
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting is used as is. Only a bare local session (unit tests) without the
    setting gets a private folder; any other master raises, because its executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="txmon-ckpt-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder (never a machine-local temp)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/txmon-scratch/{name}-{uuid.uuid4().hex[:12]}"


def ensure_folder(spark: SparkSession, path: str) -> None:
    """Create a folder through Spark's own file system layer (local or remote)."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it (a shared code folder),
    also when the session was started without it on PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, have]))
