"""The folder that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """This application's part of spark.checkpoint.dir; a local session may do without the setting."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    return f"{(found or '/tmp/checkpoints').rstrip('/')}/{context.applicationId}/streams"
