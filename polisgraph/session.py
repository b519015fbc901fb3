"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of the store that Spark takes it to be in: Hadoop's default one, without a scheme."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; set here only where it is unset and Spark is local, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    made = context._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(found or "/tmp/checkpoints")
    return qualified(spark, found or context._jsc.sc().getCheckpointDir().get())


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
