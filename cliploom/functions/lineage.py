"""Cutting the lineage of tables that rounds build on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Without that setting a local folder serves in local mode; a cluster is refused, as its executors
    would each write to their own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
