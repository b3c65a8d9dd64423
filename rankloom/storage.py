"""The folder that the driver and all executors share, and tables cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder is set once, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():  # a setting made after the context began isn't in force yet
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="rankloom-"))
    if named:
        return named
    if found.isEmpty():
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that a task can well take in the rounds of an iteration.
TASK_ROWS = 50_000


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """df of about so many rows in no more partitions than these need, but in one for each core at least.

    Rounds over tables that shrink cost by partitions, not by rows, where they keep the session's number of them.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
