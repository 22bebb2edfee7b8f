"""Session settings the jobs are written for.

The library never touches a running session; ``build_session`` is for the
benchmark, the tests and jobs that start their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Skew is left to AQE where it works at run time (joins, rebalanced writes); the
# operators themselves pre-aggregate so that no window or group sees a hot user's
# raw rows.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # rows meet their session by hash, without sorting the rows, where every partition
    # of the (much smaller) session side is seen to be below this size
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # the default, INT96, has no minima and maxima, so that a time would prune no row group
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.ui.enabled": "false",
}


def shuffle_partitions(input_bytes: int, cores: int, target_bytes: int = 128 << 20) -> int:
    """Shuffle partitions for an input size: ~128 MB each, never fewer than the cores.

    AQE merges small partitions but only splits skewed join sides, so the starting
    number has to be high enough for the data.
    """
    return max(cores, -(-input_bytes // target_bytes))


def build_session(
    app: str = "footfall",
    master: str | None = None,
    partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(BASE_CONF)
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(jvm_path)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables a job writes and reads back.

    ``spark.checkpoint.dir`` names storage every executor sees; without it a folder of the
    warehouse serves, unless that is a local folder of the driver and executors run elsewhere.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = warehouse.startswith(("file:", "/"))
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of the driver alone")
    return f"{warehouse}/_work"
