"""Sliding and session windows over a stream, with a watermark that drops what comes too late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .turns import ROCKSDB, by_arrival, run_in_turns, settings

#: Session windows merge in the map tasks, so a hot key sends its sessions, not its rows.
LOCAL = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)


def sliding_counts(stream: DataFrame, length: str = "6 hours", step: str = "2 hours", late: str = "12 hours") -> DataFrame:
    """start_hour, kind, n as windows close. ``stream``: us, kind."""
    return timed(stream, late).groupBy(F.window("at", length, step).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.expr("unix_micros(w.start) div 3600000000").alias("start_hour"), "kind", "n")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "12 hours") -> DataFrame:
    """key, start_us, end_us, n as sessions close. ``stream``: us, key."""
    return timed(stream, late).groupBy(F.session_window("at", gap).alias("w"), "key").agg(F.count(F.lit(1)).alias("n")).select("key", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def sliding_activity(rows: DataFrame, turns: int = 4) -> DataFrame:
    """start_hour, kind, n: rows of each kind in windows of six hours, every two hours, of the stream of ``rows`` (kind, ts, arrived_at) as they arrive in ``turns`` turns. Fidelity: stand-in.

    Windows are named by their start, in hours since 1970. A row is left out of a window that ends twelve hours or more before the largest time, to the millisecond, of earlier turns: that window has been given
    already. Windows are given once their end is so far behind all times; those that aren't at the end of the stream stay in its state.

    Rows without time are left out; a null arrival is that of the time; a null kind is ``none``; rows that repeat count each.
    """
    given = by_arrival(rows.select(F.coalesce("kind", F.lit("none")).alias("kind"), "ts", "arrived_at"), turns).select("us", "kind", "turn")
    with settings(rows.sparkSession, ROCKSDB):
        return run_in_turns(given, turns, sliding_counts, "start_hour long, kind string, n long")


def client_sessions(rows: DataFrame, turns: int = 4, key: str = "client_id") -> DataFrame:
    """client_id, start_us, end_us, n: sessions of a client's rows that follow one another within thirty minutes, of the stream of ``rows`` (ts, arrived_at) as they arrive. Fidelity: stand-in.

    Times are microseconds since 1970; a session ends thirty minutes after its last row. A row is left out if its own thirty minutes end twelve hours or more before the largest time of earlier
    turns; a session is given once its end is so far behind, and a row that would have prolonged it begins another. What is open at the end of the stream stays in its state.

    Rows without time or client are left out; a null arrival is that of the time; rows that repeat count each.
    """
    given = by_arrival(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "ts", "arrived_at"), turns).select("us", "key", "turn")
    with settings(rows.sparkSession, ROCKSDB | LOCAL):
        kind = given.schema["key"].dataType.simpleString()
        return run_in_turns(given, turns, session_counts, f"key {kind}, start_us long, end_us long, n long").withColumnRenamed("key", key)
