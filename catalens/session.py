"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "catalens", **conf: str) -> SparkSession:
    """Session with the settings the operators expect; `conf` keys use __ for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates.

    A cluster names it in spark.checkpoint.dir. Where that is unset, a temporary folder is taken and
    remembered in the session, but only if driver and executors are one machine: elsewhere each
    executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.catalens.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        base = tempfile.mkdtemp(prefix="spark-catalens-")
        spark.conf.set("spark.catalens.shared.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/catalens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage", large: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors.

    `large`: the shuffle files behind it are worth deleting at once, see `release`.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if large:
        release(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so when the driver collects its garbage, which may come late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of a DataFrame, used to guard broadcasts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def by_merge(df: DataFrame) -> DataFrame:
    """For the smaller side of a join that grows with the data: never broadcast. Repeated texts and lists are tiny in files and shuffles, by which
    Spark judges them, and many times that in the driver, which has to unpack them first."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work on a small input.

    A table smaller than one scan split per core would otherwise be processed by a few tasks. Larger
    inputs already come in enough splits and pass through without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark.sparkContext._jsc.sc().conf().getSizeAsBytes("spark.sql.files.maxPartitionBytes", "128m"))
    return df.repartition(cores) if estimated_bytes(df) < cores * split else df
