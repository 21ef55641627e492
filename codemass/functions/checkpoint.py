"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; only where none is named, on one machine, one of our own is set."""
    context = spark.sparkContext
    have = context.getConf().get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not have:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            have = f"/tmp/spark-checkpoints-{uuid.uuid4().hex}"
        context.setCheckpointDir(have)
    return have or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage: shuffle files of what was cut from its lineage are deleted only then."""
    spark.sparkContext._jvm.System.gc()
