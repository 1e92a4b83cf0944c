"""Where written tables, checkpoints and models of a run go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder all executors see: under ``spark.checkpoint.dir`` where the cluster names one.

    Without that setting a session in one process (tests) takes a new local folder; a cluster has to name a shared one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return os.path.join(shared, f"{name}-{uuid.uuid4().hex}")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="barspark-"), name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the work folder and read back: computed once, lineage cut, safe from executor loss."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
