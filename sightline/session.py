"""Session set-up and durable intermediate tables.

Iterative operators cut their lineage by writing a table below the folder the
cluster names in ``spark.checkpoint.dir``; the table outlives any executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: str | None = None


def build_session(app: str = "sightline", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """Session for local runs; on a cluster the submitted configuration wins."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "2048")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def durable_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The session's ``spark.checkpoint.dir`` is used when set. A local temporary
    folder is made only for local masters, where driver and executors share it.
    """
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="sightline-")
    return _LOCAL_ROOT


def durable_path(spark: SparkSession, name: str) -> str:
    """A fresh path; everything of one application lies below one folder, to be removed with it."""
    return f"{durable_root(spark)}/sightline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Lets Spark remove the shuffle files of a plan when it has run, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table; shuffle files of the write go with it."""
    spark = df.sparkSession
    path = durable_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; call it when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{durable_root(spark)}/sightline-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def use_utc(spark: SparkSession) -> None:
    """Zone-free timestamps are read as UTC instants everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
