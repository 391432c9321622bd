"""Where operators that cut lineage put their tables."""

from __future__ import annotations

import gc
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's spark.checkpoint.dir, which driver and executors share; without one, an error.

    A folder made here would be the driver's own: executors would write to their disks and later reads miss the files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder, which takes a fraction of a checkpoint; what made them may go."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    let_go(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that files of tables it no longer names go.

    Spark deletes shuffle and checkpoint files only when the driver's objects for them are collected, which may take as
    long as its heap has room; a job of many rounds would keep the files of all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
