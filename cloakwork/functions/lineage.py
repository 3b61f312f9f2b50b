"""Cut lineage: rows that are used more than once are written once, to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master (tests on one machine) without that setting gets a folder of this machine; a cluster without it
    is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), f"cloakwork-shared-{os.getpid()}")


def cut(df: DataFrame) -> DataFrame:
    """The rows without the plan that made them, written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh(stem: str) -> str:
    """A column name that no input column has by chance."""
    return f"_{stem}_{uuid.uuid4().hex[:8]}"


def remove(spark: SparkSession, folder: str) -> None:
    """The folder and all in it goes, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
