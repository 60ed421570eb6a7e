"""Cuts the lineage of a DataFrame where an iteration would pile up plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    A folder of this machine is set only for local sessions that name none; a cluster must name one.
    """
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
        folder = sc._jsc.sc().getCheckpointDir()
    return folder.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, so that what follows does not make the rows again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
