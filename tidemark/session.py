"""Where a job may write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a session that names none (a test on one machine) gets a temporary folder,
    which is then set as its checkpoint folder so later calls find the same one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def run_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses. Nothing is created yet."""
    return f"{shared_folder(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
