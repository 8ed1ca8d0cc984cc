"""The shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the cluster's checkpoint folder; one is set only where none is.

    Then it lies in the warehouse, which all executors share, or, where driver and executors are one
    process, in a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="ckpt") if sc.master.startswith("local[") or sc.master == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
