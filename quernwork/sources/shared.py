"""The shared folder in which executors and driver both find written data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session may go without one and gets a temporary folder; on a
    cluster such a folder would be seen by one machine alone, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="quernwork-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A folder name not used before, under the shared folder."""
    shared = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{shared}/quernwork/{purpose}-{uuid.uuid4().hex}"
