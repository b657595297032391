"""The folder that the driver and all executors share, for tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where the session has none, a temporary folder is made if all runs on one
    machine; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
