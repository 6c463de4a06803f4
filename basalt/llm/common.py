"""Shared helpers: shared storage, checked broadcasts, text constants."""

from __future__ import annotations

import re
import tempfile
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: blank and \t \n \v \f \r.
WORD_RE = r"[^\x20\x09-\x0D]+"
TRIM_CHARS = "\x20\t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only when counted below this many bytes.
BROADCAST_BYTES = 24 << 20


K1, K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * K1
    x = (x ^ (x >> np.uint64(27))) * K2
    return x ^ (x >> np.uint64(31))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; elsewhere a missing
    setting is an error, since executors could not read one another's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basalt-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute now and cut the lineage with a reliable checkpoint."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint if ``rows`` (a count taken before) of ``row_bytes`` fit BROADCAST_BYTES.

    Otherwise the frame comes back as it is and Spark joins by shuffle, splitting skew at run time.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def body(text) -> F.Column:
    """The text, with null as empty."""
    return F.coalesce(text, F.lit(""))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of the Arrow batches that Python workers hold; their bytes are bounded by spark.sql.execution.arrow.maxBytesPerBatch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def with_columns_of(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in wanted])


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
