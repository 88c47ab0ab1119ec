"""Session settings for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "slipweave", memory: str = "16g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", os.environ.get("TMPDIR", "/tmp") + "/slipweave-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def dealt(df: DataFrame) -> DataFrame:
    """``df`` marked to be dealt out by its join's key instead of being broadcast, whatever size the planner takes it for.

    For tables that grow with the slips: the planner knows a staged file's compressed bytes, which are far fewer than its rows take in memory.
    """
    return df.hint("merge")


def stage(df: DataFrame) -> DataFrame:
    """Compute a table once that later steps read many times.

    Where the cluster names a shared folder the table is written there, which also keeps the plan short, lets later
    steps read only the columns they need and tells the planner how small it is; elsewhere it is cached and rebuilt
    from its lineage if an executor is lost.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None):
        path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for data all executors share; a local session may do with a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by the cluster; ``fallback`` only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if fallback is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback
