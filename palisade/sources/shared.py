"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; only a local master may do without one (tests): there a temporary folder is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder, and a cluster needs one")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="palisade-"))
    return context.getCheckpointDir()
