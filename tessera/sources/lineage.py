"""Cutting the lineage of iterative jobs in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; a temporary one is set only where none is configured (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, suffix: str = "") -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}{suffix}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that later jobs neither recompute it nor depend on one executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
