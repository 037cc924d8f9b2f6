"""Session, checkpoint folder and scratch paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "pluvia", cpus: str | int = "*", **conf) -> SparkSession:
    """Local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_dir(spark: SparkSession) -> str:
    """Folder the cluster names in spark.checkpoint.dir; a temp folder only in local mode."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = sc.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not (sc.master == "local" or sc.master.startswith("local[")):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="pluvia-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the partitions are files, so an executor loss cannot change them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder, for tables written and read again."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_dir(spark))
    return f"{sc.getCheckpointDir().rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of the rows' size, without a job; None where it does not know (local and RDD rows)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: work is done once and survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
