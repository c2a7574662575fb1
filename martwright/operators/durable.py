"""Intermediate results that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all nodes see, as named by the session.

    Only a session in one process (``local[...]``) gets a temporary folder where the setting is
    missing.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master.partition("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all nodes")
            folder = tempfile.mkdtemp(prefix="martwright-")
        context.setCheckpointDir(folder)
        current = context.getCheckpointDir()
    return current


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
