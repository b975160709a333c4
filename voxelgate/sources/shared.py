"""Folders that all executors share, for files and tables between two steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import files


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it isn't set, one of this machine if all runs on it; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="voxelgate-")
        atexit.register(files.delete, named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder, which goes when this process ends, with what was written there.

    The results of lazy queries read it until then.
    """
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    for suffix in ("", ".npy", ".pcd", ".json", ".bin"):
        atexit.register(files.delete, folder + suffix)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table in the shared folder; its partitions stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
