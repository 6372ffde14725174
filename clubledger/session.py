"""Session helpers: where intermediate tables may be written."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as named by the cluster.

    Only a local session that names none gets a folder of its own, with a warning;
    on a cluster a folder on one machine would be lost with that machine. Nothing
    is set on the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    name = f"clubledger-{spark.sparkContext.applicationId}"
    folder = os.path.join(tempfile.gettempdir(), name)
    warnings.warn(f"spark.checkpoint.dir is not set; this local session uses {folder}", stacklevel=2)
    return folder


def new_table_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a
    recomputation, and gives later joins true sizes to plan with.
    """
    path = new_table_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``write_through`` and the number of rows, which the write itself counts."""
    seen = Observation()
    written = write_through(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return written, seen.get["n"]


def remove_written(df: DataFrame) -> None:
    """Delete a table of ``write_through`` that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folders = {os.path.dirname(f) for f in df.inputFiles()}
    own = checkpoint_dir(spark).rstrip("/").split(":")[-1].lstrip("/")
    for folder in folders:
        if own in folder:
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
