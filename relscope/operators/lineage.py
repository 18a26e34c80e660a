"""Cutting lineage in iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine.
FALLBACK_DIR = "/tmp/relscope-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (shared or FALLBACK_DIR).rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where this application's cut tables are."""
    return f"{shared_dir(spark)}/relscope-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read back; it outlives the loss of any executor.

    It is computed once, and what reads it has statistics and column pruning, which a checkpoint hasn't. The tables of an
    application stay until `clear`.
    """
    path = f"{session_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all cut tables of the application; frames that read them can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
