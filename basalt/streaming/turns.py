"""Feeding a stream by turns: rows in the order of their arrival, each turn a new start of the query on one checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import epoch_micros
from ..sources import removed, shared_dir, written

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def by_arrival(rows: DataFrame, turns: int, arrived: str = "arrived_at", at: str = "ts") -> DataFrame:
    """``rows`` that have a time, with ``us``, that time in microseconds, and their ``turn``: equal stretches of the time of arrival, which is that of the row if null."""
    timed = rows.where(F.col(at).isNotNull()).withColumn("us", epoch_micros(at))
    timed = timed.withColumn("__came", F.coalesce(epoch_micros(arrived), "us"))
    low, high = timed.agg(F.min("__came"), F.max("__came")).head()
    low, high = low or 0, high or 0
    return timed.withColumn("turn", F.expr(f"((__came - {low}) * {turns}) div {high - low + 1}").cast("int")).drop("__came")


def run_in_turns(rows: DataFrame, turns: int, build: Callable[[DataFrame], DataFrame], out: str, root: str | None = None) -> DataFrame:
    """What ``build`` of a stream of ``rows`` (with ``turn``, from 0) gives in append mode, of schema ``out``, after all turns.

    Turns lie in folders under ``root``, a new one in the shared folder if not given; a start takes in the folder that is new. After a turn
    Spark runs once more without data, if the watermark has moved, so what has closed is out before the next turn; the next turn's late rows
    are those behind the largest time of the turns before it, less the delay. Output goes to a file sink, exactly once, and is kept as a checkpoint while the folder goes.
    """
    spark = rows.sparkSession
    own = root or f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}"
    columns = [c for c in rows.columns if c != "turn"]
    schema = rows.select(*columns).schema
    try:
        rows.write.partitionBy("turn").parquet(f"{own}/in")
        there = {r["turn"] for r in spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.fields)}, turn int").parquet(f"{own}/in").select("turn").distinct().collect()}  # a row a turn
        if not there:
            return spark.createDataFrame([], out)
        for turn in range(turns):
            if turn not in there:
                spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{own}/in/turn={turn}")
            stream = spark.readStream.schema(schema).parquet(f"{own}/in/turn={{{','.join(map(str, range(turn + 1)))}}}")
            query = build(stream).writeStream.format("parquet").option("path", f"{own}/out").option("checkpointLocation", f"{own}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        return written(spark.read.schema(out).parquet(f"{own}/out"))
    finally:
        if not root:
            removed(spark, own)
