"""Reading tables and writing results."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; the schema comes from the files, and Spark prunes columns and pushes filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_markdown(df: DataFrame, path: str, column: str = "markdown") -> None:
    """Write a column of Markdown as text files, one part a task."""
    df.select(df[column].alias("value")).write.text(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session without that setting gets a temporary folder."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="basalt-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Compute now and keep the result as a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
