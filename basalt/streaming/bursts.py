"""Bursts tracked in keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .turns import ROCKSDB, by_arrival, run_in_turns, settings

MINUTE = 60_000
OUT = "key long, first_minute long, last_minute long, n long"
#: Different minutes of keys that a map task sums before it sends them on.
HELD = 1 << 16


def fold(open_burst: tuple | None, minutes: list[tuple[int, int]], now: int, quiet: int):
    """Closed bursts and the open one, after ``minutes`` (minute, n; ascending, all before the minute ``now``) have followed ``open_burst`` (first, last, n)."""
    closed = []
    for minute, n in minutes:
        if open_burst and minute - open_burst[1] > quiet:
            closed.append(open_burst)
            open_burst = None
        open_burst = (open_burst[0], minute, open_burst[2] + n) if open_burst else (minute, minute, n)
    if open_burst and now - open_burst[1] > quiet:  # what may still come begins another
        closed.append(open_burst)
        open_burst = None
    return closed, open_burst


class Bursts(StatefulProcessor):
    """A key's minutes that the watermark hasn't passed, and its open burst. Minutes are folded in order once it has passed them, so the cut into micro-batches makes no difference."""

    def __init__(self, least: int, quiet: int):
        self.least, self.quiet = least, quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "minutes array<long>, counts array<long>, first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, pending, open_burst = self.now(timerValues), *self.held()
        for r in rows:
            if r.minute >= now:  # behind the watermark is too late
                pending[r.minute] = pending.get(r.minute, 0) + r.n
        yield from self.settle(key[0], now, pending, open_burst)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.settle(key[0], self.now(timerValues), *self.held())

    def now(self, timer_values) -> int:
        """The minute that the watermark stands in; those before it are complete."""
        return timer_values.getCurrentWatermarkInMs() // MINUTE

    def held(self) -> tuple[dict[int, int], tuple | None]:
        if not self.state.exists():
            return {}, None
        minutes, counts, first, last, n = self.state.get()
        return dict(zip(minutes, counts, strict=True)), None if first is None else (first, last, n)

    def settle(self, key, now: int, pending: dict[int, int], open_burst: tuple | None) -> Iterator[Row]:
        due = sorted(m for m in pending if m < now)
        closed, open_burst = fold(open_burst, [(m, pending.pop(m)) for m in due], now, self.quiet)
        for first, last, n in closed:
            if n >= self.least:
                yield Row(key=key, first_minute=first, last_minute=last, n=n)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if pending or open_burst:
            self.state.update((list(pending), list(pending.values()), *(open_burst or (None, None, None))))
            # the next minute that completes, or the end of the quiet after the open burst
            deadline = min([m + 1 for m in pending] + ([open_burst[1] + self.quiet + 1] if open_burst else []))
            self.handle.registerTimer(deadline * MINUTE - 1)
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def summed(batches):
    """Rows of key, minute, n added up within a map task, so that a hot key sends its minutes, not its rows."""
    held: list[pa.Table] = []

    def added() -> pa.Table:
        t = pa.concat_tables(held).group_by(["key", "minute"]).aggregate([("n", "sum")])
        return pa.table({"key": t["key"], "minute": t["minute"], "n": t["n_sum"]}).combine_chunks()

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(map(len, held)) > 2 * HELD:
            held[:] = [added()]
            if len(held[0]) > HELD:
                yield from held.pop().to_batches()
    if held:
        yield from added().to_batches()


def bursts(stream: DataFrame, least: int, quiet: int, late: str) -> DataFrame:
    """key, first_minute, last_minute, n as bursts end. ``stream``: us, key."""
    timed = stream.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    minutes = timed.select("key", F.expr("us div 60000000").alias("minute"), F.lit(1).cast("long").alias("n")).mapInArrow(summed, "key long, minute long, n long")
    return minutes.groupBy("key").transformWithState(Bursts(least, quiet), OUT, "Append", "EventTime")


def error_bursts(rows: DataFrame, turns: int = 4, least: int = 3, quiet: int = 120, late: str = "4 days", kind: str = "error") -> DataFrame:
    """client_id, first_minute, last_minute, n: series of at least ``least`` errors of a client in which none comes more than ``quiet`` minutes after the last, of the stream of ``rows`` as they arrive. Fidelity: stand-in.

    Minutes count from 1970. Clients are keys of a state that holds the minutes which may still change and the burst that may still
    go on; a timer wakes a client when the watermark has passed the next of them, so a burst is told without a further row. Rows come at most
    ``late`` after others of later time, or are left out; with none such, the result doesn't depend on the turns. What hasn't ended at the end of the stream stays in its state.

    Rows without time or client are left out; a null arrival is that of the time; rows that repeat count each. Times lie after 1970.
    """
    given = rows.where((F.col("kind") == kind) & F.col("client_id").isNotNull()).select(F.col("client_id").cast("long").alias("key"), "ts", "arrived_at")
    given = by_arrival(given, turns).select("us", "key", "turn")
    with settings(rows.sparkSession, ROCKSDB):
        return run_in_turns(given, turns, lambda s: bursts(s, least, quiet, late), OUT).withColumnRenamed("key", "client_id")
