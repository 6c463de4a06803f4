"""Activity tracking over a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import removed, shared_dir, written


def daily_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n as days close: tumbling days with a watermark. ``events``: ts, event_type."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def activity_stream(spark: SparkSession, path: str, state_dir: str | None = None) -> DataFrame:
    """day, event_type, n of the Parquet files at ``path``, run as a stream; a further run over the same ``state_dir`` reads new files only.

    Counts pre-aggregate in the map tasks and are kept in the stream's state without a watermark, so late events count too; the
    result is read from that state. Events without time are left out; a null type is one type.
    """
    own = None if state_dir else f"{shared_dir(spark)}/activity-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = spark.read.parquet(path).schema
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a path as a folder unless it is a pattern
    events = spark.readStream.schema(schema).parquet(path).where("ts IS NOT NULL")
    counts = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))
    try:
        counts.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir or own).trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").load(state_dir or own)
        return written(state.select(F.col("key.day").alias("day"), F.col("key.event_type").alias("event_type"), F.col("value.count").alias("n")))
    finally:
        if own:
            removed(spark, own)
