"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "riskweave",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job relies on.

    UTC session time so ``hour()`` agrees with other engines, AQE on for
    runtime partition coalescing and skew splitting, and no web UI.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Only takes effect when this call starts the JVM (local runs).
        "spark.driver.memory": _local_driver_memory(),
        # Remove checkpoint files of lineages that are no longer referenced.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def _local_driver_memory() -> str:
    """Half of this machine's memory, between 1 and 8 GiB (local mode only)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    gib = max(1, min(8, int(total / 2 / 2**30)))
    return f"{gib}g"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; we only create our own
    (a scratch folder) when it is unset, which happens in local tests.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="riskweave-ckpt-")
        sc.setCheckpointDir(d)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system that holds it (local, HDFS or an object store)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back.

    Cuts the lineage of large tables: columnar files are a fraction of a
    checkpoint's size, and later reads take only the columns they need.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scale_conf(input_bytes: float, total_cores: int, shuffle_fraction: float = 0.2,
               target_partition_bytes: int = 256 * 2**20) -> dict:
    """Settings for a cluster run sized from the input volume.

    * scans: ``maxPartitionBytes`` = target size, so a 100 TB input gives
      about 400k scan tasks (hundreds of waves on 8k cores, each task small);
    * shuffles: the initial partition count covers the expected shuffled
      bytes (pruned columns are a fraction of the input) at the target size,
      at least 3 tasks per core; AQE then coalesces small partitions and
      splits skewed ones at the same advisory size.
    """
    shuffle_bytes = max(input_bytes * shuffle_fraction, 1)
    parts = max(3 * total_cores, int(shuffle_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        # Broadcasts in this package are fixed lists or tables bounded by
        # construction; keep Spark's own size-based broadcast modest.
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 2**20),
    }
