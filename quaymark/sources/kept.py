"""Tables that several plans read, computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none, a local run gets a temporary one; on a cluster that would be one machine's own, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return (named or own.get()).rstrip("/")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quaymark-")
        atexit.register(shutil.rmtree, path, True)
        named = f"file://{path}"
    spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and stored in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
