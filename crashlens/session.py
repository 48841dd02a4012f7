"""Session set-up and the shared staging folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app_name: str = "crashlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session with the settings the library relies on.

    On a cluster pass ``master=None`` and let spark-submit decide; ``shuffle_partitions``
    should then be sized so that one shuffle partition holds roughly 128-256 MB.
    AQE coalesces small partitions and splits skewed join partitions at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Parquet and ORC sizes are compressed; rows in a broadcast hash table take several
        # times as much memory. Scaling the file-size estimate keeps the planner from
        # broadcasting a table that only looks small on disk; AQE can still broadcast at run
        # time from the measured size of a shuffle.
        "spark.sql.sources.fileCompressionFactor": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables and checkpoints.

    Read from ``spark.checkpoint.dir`` as set by the cluster. Only when it is unset in
    local mode (local runs, tests) a fresh local folder is made and registered with the
    context, so every later call sees the same folder; on a cluster an unset folder is an
    error.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        if not sc.master.startswith("local"):
            # A driver-local folder is not shared with the executors of a cluster.
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="crashlens-ckpt-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint folder for one staged table."""
    return os.path.join(checkpoint_dir(spark), "staged", name)


# Target bytes per shuffle partition and per scan split at scale; AQE merges smaller ones.
TARGET_PARTITION_BYTES = 512 * 1024 * 1024


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the input files (a metadata call to the file system, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        # A path may be a pattern, as in spark.read.
        for status in fs.globStatus(path) or ():
            total += fs.getContentSummary(status.getPath()).getLength()
    return int(total)


def partitions_for(total_bytes: int, cores: int, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partitions (or buckets) for an input: one per ``target_bytes``, at least three per core."""
    return max(3 * cores, -(-total_bytes // target_bytes))


def scale_conf(total_bytes: int, cores: int, target_bytes: int = TARGET_PARTITION_BYTES) -> dict[str, str]:
    """Shuffle and scan sizing for an input of ``total_bytes`` on ``cores`` task slots.

    About one shuffle partition per ``target_bytes`` of input, at least three per core, so a
    partition fits an executor's memory share without spilling much; AQE then merges
    partitions below the advisory size and splits skewed join partitions above five times the
    median. Scans are cut into at least one split per core.
    """
    parts = partitions_for(total_bytes, cores, target_bytes)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(min(target_bytes, 256 * 1024 * 1024)),
        "spark.sql.files.maxPartitionBytes": str(min(target_bytes, 256 * 1024 * 1024)),
        "spark.sql.files.minPartitionNum": str(cores),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


def apply_scale_conf(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Size the session for the given inputs unless shuffle partitions were set explicitly."""
    if "spark.sql.shuffle.partitions" in spark.conf.getAll:
        return {}
    conf = scale_conf(input_bytes(spark, paths), spark.sparkContext.defaultParallelism)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
