"""The folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veilframe.errors import misconfigured


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names, or one of our own where none is set and all is one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise misconfigured("GENERAL_FAILURE", "set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or "/tmp/checkpoints")
    return context.getCheckpointDir()
