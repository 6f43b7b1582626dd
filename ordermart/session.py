"""Session construction and the shared work folder.

Cluster code never invents a machine-local temp folder: intermediate tables
go under the folder the cluster names in ``spark.checkpoint.dir``. Only when
that setting is unset (local tests) do we choose one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings every job relies on. UTC keeps timestamp_ntz arithmetic and
# date_trunc identical to the DuckDB oracle; AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splitting handles hot keys.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for a large cluster (~1000 executors, ~100 TB of input). AQE
# starts every shuffle wide and coalesces to the advisory size at runtime,
# so partitions fit executor memory at any scale without hand-tuning; joins
# are converted to broadcast only when the *measured* side is under the AQE
# threshold; skewed partitions are split even when that costs an extra
# shuffle (a key may own a third of all rows).
SCALE_CONF = {
    "spark.sql.shuffle.partitions": "32768",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "32768",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_spark(
    master: str | None = None,
    app: str = "ordermart",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
    scale: bool = False,
) -> SparkSession:
    """Build (or reuse) a session with the library's baseline settings.

    ``scale=True`` adds ``SCALE_CONF`` for cluster runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **(SCALE_CONF if scale else {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Settings that must hold even when an existing session was reused.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_LOCAL_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A sub-folder of the cluster's shared checkpoint folder.

    Reads ``spark.checkpoint.dir`` from the session (a static setting: it is
    never modified here), then the context's checkpoint folder. Only when
    neither exists (tests or a bare local session) is a folder created under
    the system temp directory and registered with ``setCheckpointDir``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to storage that all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS.get(app)
        if root is None:
            root = tempfile.mkdtemp(prefix="ordermart-ckpt-")
            spark.sparkContext.setCheckpointDir(root)
            _LOCAL_ROOTS[app] = root
    leaf = name or uuid.uuid4().hex
    return os.path.join(root, leaf) if "://" not in root else f"{root.rstrip('/')}/{leaf}"


def storage(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def file_state(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Length and time of a file or folder, on any storage Spark reads."""
    fs, where = storage(spark, path)
    if not fs.exists(where):
        return None
    status = fs.getFileStatus(where)
    return fs.getContentSummary(where).getLength(), status.getModificationTime()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables."""
    fs, where = storage(spark, path)
    fs.delete(where, True)
