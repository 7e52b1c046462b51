"""Cutting lineage: iterative operators store each round in the folder that the cluster shares."""

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is named, a session on one machine takes a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veinway-"))
    return sc.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder: computed once, and not again when executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
