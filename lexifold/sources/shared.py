"""Tables written on the way, in the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local master gets one of its own; a cluster has to
    name it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows of a table as written to the shared folder, so that what reads them again doesn't compute them again."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
