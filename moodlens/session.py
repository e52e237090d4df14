"""Session helpers: a tuned SparkSession and a shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Configuration that every job in this package assumes.  AQE re-plans joins
# and partition counts from runtime statistics; skew-join splits oversized
# shuffle partitions.  Values that depend on the cluster (executor memory,
# shuffle partitions at 100 TB) are left to spark-defaults on the cluster.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


# Sizing for large inputs (set once per job from the input size; AQE then
# coalesces small partitions and splits skewed ones at run time).
TARGET_PARTITION_BYTES = 256 * 1024 * 1024
MIN_SHUFFLE_PARTITIONS = 200


def scale_conf(input_bytes: int, text_heavy: bool = False) -> dict[str, str]:
    """Settings sized for ``input_bytes`` of (compressed) input.

    * initial shuffle partitions ~ input / 256 MB (AQE coalesces down to the
      advisory size; starting high keeps each reducer's share bounded when a
      key holds a large fraction of the rows);
    * scan splits of 256 MB, or 64 MB for long texts (they expand several
      times when decompressed and lower-cased/tokenised);
    * skew join: a partition 4x the median and above 256 MB is split.
    """
    parts = -(-int(input_bytes) // TARGET_PARTITION_BYTES)
    parts = max(MIN_SHUFFLE_PARTITIONS, parts)
    split = 64 * 1024 * 1024 if text_heavy else TARGET_PARTITION_BYTES
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(TARGET_PARTITION_BYTES),
    }


def apply_scale_conf(spark: SparkSession, input_bytes: int, text_heavy: bool = False) -> None:
    """Apply :func:`scale_conf` to a running session (runtime SQL settings)."""
    for k, v in scale_conf(input_bytes, text_heavy).items():
        spark.conf.set(k, v)


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Size of input files and folders, asked of the file system that holds them."""
    total = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def get_spark(master: str | None = None, app: str = "moodlens", **conf) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    ``master`` is only set when given (tests, bench); on a cluster it comes
    from spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read here;
    if it is missing there, this fails instead of falling back to a
    machine-local folder.  In local mode (tests) an unset value is replaced
    by a private temporary folder, registered so later code can rely on it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_ROOTS.get(sc.applicationId)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder shared by "
                               "all executors (e.g. HDFS or object storage)")
        # spark.checkpoint.dir cannot be changed on a running session; keep
        # the private folder for this application instead.
        root = tempfile.mkdtemp(prefix="moodlens-ckpt-")
        _LOCAL_ROOTS[sc.applicationId] = root
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/moodlens/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Sets session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
