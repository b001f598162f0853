"""A folder that driver and executors share, for data that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset in a local session (tests), below a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reelmill-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"
