"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every gpsight session wants. AQE re-plans joins from runtime sizes (a size-checked
# broadcast with sort-merge as the fallback) and splits skewed shuffle partitions.
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def scale_settings(input_bytes: int, total_cores: int,
                   target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Partition sizing for a given input volume and cluster size.

    * input splits of ``target_partition_bytes`` (``spark.sql.files.maxPartitionBytes``);
    * enough shuffle partitions that each holds about one split's worth of the largest
      shuffle (at least 2 per core, so every core has work in every stage) — AQE then
      coalesces small ones towards the same advisory size and splits skewed ones;
    * a skewed partition is one 4x the median and above 2x the advisory size.

    For 100 TB on 1,000 executors x 8 cores: 409,600 splits, 409,600 shuffle partitions.
    """
    partitions = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        # coalesce towards the advisory size, not towards maximum parallelism
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
    }


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "gpsight",
    extra: dict[str, str] | None = None,
    input_bytes: int | None = None,
    total_cores: int | None = None,
) -> SparkSession:
    """Create (or reuse) a session with gpsight's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide, and give the expected
    ``input_bytes`` and ``total_cores`` so that splits and shuffle partitions are sized by
    :func:`scale_settings`; an explicit ``shuffle_partitions`` wins over that sizing.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_DEFAULTS)
    if input_bytes is not None and total_cores is not None:
        settings.update(scale_settings(input_bytes, total_cores))
    for key, value in settings.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when it is unset and the session runs in local
    mode (tests) is a scratch folder created and registered with the context, once: later calls
    return the same one, as they return a folder set by ``setCheckpointDir``. On a cluster an
    unset folder is an error, since a machine-local folder is not shared.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not configured and current.isDefined():
        return current.get()  # set by setCheckpointDir, here or by the caller
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name shared storage (HDFS, S3, ...) "
                               "when running on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gpsight-ckpt-"))
        return sc._jsc.sc().getCheckpointDir().get()
    if not current.isDefined():
        sc.setCheckpointDir(configured)
    return configured


def _copies(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/gpsight-materialized/{spark.sparkContext.applicationId}"


def remove_written(spark: SparkSession, label: str | None = None) -> int:
    """Delete what :func:`materialize` has written in this application (only ``label``'s, if given);
    the number of folders.

    Copies of other applications that share the folder stay. Call it when no query that reads
    the copies runs any more.
    """
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{_copies(spark)}/{label or ''}*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    return sum(bool(fs.delete(status.getPath(), True)) for status in found)


# Removes the shuffle files of a query at its end; else they stay until the driver happens to collect its garbage.
RELEASE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Used where a plan would otherwise compute the same intermediate result twice (two
    consumers whose column sets differ, so Spark cannot reuse the exchange). One job computes
    the result; the written copy survives executor loss and cuts the lineage, like
    ``checkpoint()`` but without its second computation pass. With ``release`` the shuffle files
    of that job go as soon as the copy is written.
    """
    spark = df.sparkSession
    path = f"{_copies(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE_SETTING, None)
    if release:
        spark.conf.set(RELEASE_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE_SETTING) if before is None else spark.conf.set(RELEASE_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)
