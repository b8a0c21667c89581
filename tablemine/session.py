"""SparkSession helpers: one place for the engine's session defaults."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "tablemine",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build one with the engine's defaults.

    On a cluster the submitter owns master, memory and checkpoint settings;
    this only fills in what is unset.  AQE stays on so that shuffle
    partition counts, broadcast conversion and skewed joins are re-planned
    from runtime sizes.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # long LaTeX strings are split into many regex pieces; keep plans compact
        "spark.sql.optimizer.collapseProjectAlwaysInline": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if (master or "").startswith("local") and not os.environ.get("SPARK_DRIVER_MEMORY"):
        # local mode runs every task inside the driver JVM: size its heap
        # (a submitted job keeps the cluster's own setting)
        conf["spark.driver.memory"] = os.environ.get("TABLEMINE_LOCAL_MEMORY", "16g")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder for cutting lineage in iterative operators.

    Uses the cluster's ``spark.checkpoint.dir`` (a shared folder) when set.
    Only a local-mode session without one gets a fresh folder under the
    system temp dir (tests, laptops); a cluster session without the setting
    is an error, since a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/...) so iterative operators can cut lineage")
    path = tempfile.mkdtemp(prefix="tablemine-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or os.path.abspath(path)


def written(df, name: str):
    """``df`` as a Parquet table in the checkpoint folder, read back: it is made
    once, and what reads it takes only the columns it needs (a checkpoint hands
    out whole rows, one by one)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_parallelism(df, factor: int = 2):
    """Spread a CPU-heavy text stage over the cluster's cores.

    Text operators (regexes, higher-order functions) cost CPU per row, not
    bytes; a source with fewer partitions than cores (one big file, one row
    group, or AQE coalescing a small shuffle) would run them in a handful of
    tasks.  Only then is a round-robin repartition added; an input that is
    already wide is left untouched (no extra shuffle at scale).
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism * factor
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. Spark Connect): leave as is
        return df
    return df if n >= target else df.repartition(target)


def text_partitions(spark, factor: int = 2) -> int:
    """Explicit partition count for shuffles that feed text operators (AQE
    does not coalesce a repartition with an explicit count)."""
    return max(spark.sparkContext.defaultParallelism * factor,
               int(spark.conf.get("spark.sql.shuffle.partitions")))
