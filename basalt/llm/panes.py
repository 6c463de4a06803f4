"""Hourly panes of timed rows with grace, revisions and closing, kept by a stateful streaming query.

A pane is a kind and a floored event hour. Each batch of files starts the query anew on one checkpoint. Keys of the state are shards of a kind and
a day: a shard's ``MapState`` holds the totals of its hours and whether they were emitted, another the hours that are
dirty (emitted before, with rows since) and what was emitted for them. A single timer per shard stands at the earliest deadline of its panes: the
end of the grace of one not yet emitted, the closing of one that was. It is set anew whenever a shard was
settled, so a shard without new rows wakes only when something is due.

The watermark W is Spark's own: the largest event time of all earlier batches, without delay; no row is dropped by it, since the column that carries
it ends before the state. Spark keeps no watermark below zero, so event times are shifted by ``SHIFT_MS`` for it alone. What
was never due is read from the state after the last batch.

Rows are combined in their map tasks, one row a pane and task, so that a hot kind reaches its shards as sums. Rows of closed panes can't be combined, as each
is an output; they are dealt by a hash to further shards of the same kind and day, as many as shuffle partitions. Nothing but the largest event time of each batch
reaches the driver. Output goes to a file sink, whose log makes it exactly-once; a lost executor repeats its tasks from the state's
last version.

Defined cases: rows without time are dropped; rows of one identifier count once, the one of smallest arrival, time, kind and value (nulls first); null identifiers are one identifier, which
adds nothing to its day's batch; a null arrival is taken from the time; null values and those that are no finite number count 0; a null kind is ``none``; a batch without rows still
starts the query; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from . import common
from .exact_dedup import STATE
from .common import settings

HOUR_MS = 3_600_000
#: After a pane's end: when it is due, and when it takes no more rows.
GRACE_MS = 6 * HOUR_MS
CLOSE_MS = 4 * 24 * HOUR_MS
#: Added to event times for the watermark, which Spark holds at zero or above.
SHIFT_MS = 10_000 * 365 * 24 * HOUR_MS
BATCHES = 8
#: Panes that a map task sums before it sends them on.
HELD = 1 << 16
#: Files of the state carry no second checksum besides the file system's own, so that a partition without rows costs little.
QUICK = {"spark.sql.streaming.checkpoint.fileChecksum.enabled": "false"}
OUT = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"


def end_ms(hour: int) -> int:
    return (hour + 1) * HOUR_MS


def due(hour: int, w: int | None) -> bool:
    return w is not None and w >= end_ms(hour) + GRACE_MS


def closed(hour: int, w: int | None) -> bool:
    return w is not None and w >= end_ms(hour) + CLOSE_MS


class Panes(StatefulProcessor):
    """The state of a shard. ``batch`` is written into each record."""

    def __init__(self, batch: int):
        self.batch = batch

    def init(self, handle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "hour long", "n_rows long, cents long, emitted boolean")
        self.dirty = handle.getMapState("dirty", "hour long", "n_rows long, cents long")

    def record(self, kind: str, hour: int, record: str, n: int, cents: int, click_id=-1) -> Row:
        return Row(batch=self.batch, hour=hour, click_id=click_id, n_rows=n, cents=cents, record=record, kind=kind)

    def watermark(self, timer_values) -> int | None:
        w = timer_values.getCurrentWatermarkInMs()
        return None if w <= 0 else w - SHIFT_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kind, w, added = key[0], self.watermark(timerValues), {}
        for r in rows:
            if closed(r.hour, w):
                yield self.record(kind, r.hour, "late", r.n_rows, r.cents, r.click_id)
            else:
                n, cents = added.get(r.hour, (0, 0))
                added[r.hour] = n + r.n_rows, cents + r.cents
        for hour, (n, cents) in added.items():
            old_n, old_cents, emitted = self.panes.getValue((hour,)) if self.panes.containsKey((hour,)) else (0, 0, False)
            if emitted:
                self.dirty.updateValue((hour,), (old_n, old_cents))
            self.panes.updateValue((hour,), (old_n + n, old_cents + cents, emitted))
        if added:
            yield from self.settle(kind, w)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.settle(key[0], self.watermark(timerValues))

    def settle(self, kind: str, w: int | None) -> Iterator[Row]:
        """Emit what is due, revise what is dirty, forget what is closed, and set the timer to the next deadline."""
        revised = {hour: old for (hour,), old in self.dirty.iterator()}
        deadline = None
        for (hour,), (n, cents, emitted) in sorted(self.panes.iterator()):
            if not emitted and due(hour, w):
                yield self.record(kind, hour, "emit", n, cents)
                emitted = True
                self.panes.updateValue((hour,), (n, cents, True))
            elif hour in revised:
                yield self.record(kind, hour, "retract", *revised[hour])
                yield self.record(kind, hour, "replace", n, cents)
            if closed(hour, w):
                self.panes.removeKey((hour,))
            else:
                at = end_ms(hour) + (CLOSE_MS if emitted else GRACE_MS)
                deadline = at if deadline is None else min(deadline, at)
        self.dirty.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if deadline is not None:
            self.handle.registerTimer(deadline + SHIFT_MS - 1)  # a timer fires once the watermark is beyond it

    def close(self) -> None:
        pass


def combined(w: int | None):
    """A map over Arrow batches: rows of open panes summed by pane, shard 0; rows of panes closed at ``w`` as they are, dealt to shards 1 and on."""
    names = ["kind", "day", "shard", "hour", "click_id", "n_rows", "cents"]
    limit = None if w is None else (w - CLOSE_MS) // HOUR_MS - 1  # the last closed hour

    def out(kind, hour, click_id, shard, n, cents) -> pa.RecordBatch:
        hour = hour.cast(pa.int64())
        # floored division of a number that may be negative
        day = pc.floor(pc.divide(hour.cast(pa.float64()), 24.0)).cast(pa.int64())
        return pa.RecordBatch.from_arrays([kind, day, shard, hour, click_id, n, cents], names=names)

    def work(batches):
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by(["kind", "hour"]).aggregate([("n_rows", "sum"), ("cents", "sum")])
            return pa.table({"kind": t["kind"], "hour": t["hour"], "n_rows": t["n_rows_sum"], "cents": t["cents_sum"]})

        def flush() -> pa.RecordBatch:
            t = summed().combine_chunks()
            none = pa.nulls(len(t), pa.int64())
            one = lambda c: t[c].combine_chunks()
            return out(one("kind"), one("hour"), none, pa.array([0] * len(t), pa.int64()), one("n_rows"), one("cents"))

        for b in batches:
            t = pa.Table.from_batches([b])
            if limit is not None:
                shut = pc.less_equal(t["hour"], limit)
                late = t.filter(shut).combine_chunks()
                t = t.filter(pc.invert(shut))
                if len(late):
                    one = lambda c: late[c].combine_chunks()  # noqa: B023, E731
                    yield out(one("kind"), one("hour"), one("click_id"), one("shard"), pa.array([1] * len(late), pa.int64()), one("cents"))
            if len(t):
                held.append(pa.table({"kind": t["kind"], "hour": t["hour"], "n_rows": pa.array([1] * len(t), pa.int64()), "cents": t["cents"]}))
            if sum(map(len, held)) > 2 * HELD:
                held[:] = [summed()]
                if len(held[0]) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return work


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5); 0 for null and for what is no finite number."""
    x = value * 100 + 0.5
    return F.when(F.abs(x) < F.lit(9e15), F.floor(x)).otherwise(0).cast("long")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time that has no zone, whatever the session's."""
    time = F.expr(f"hour({ts}) * 3600 + minute({ts}) * 60").cast("long") * 1_000_000 + (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("long")
    return F.unix_date(F.col(ts).cast("date")).cast("long") * (24 * HOUR_MS * 1000) + time


def staged(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """batch, click_id, kind, hour, event_ms, cents: each identifier once, dealt to batches by its day of arrival and a delay drawn from its identifier."""
    rows = clicks.where("ts IS NOT NULL").select("click_id", F.struct("arrived_at", "ts", "kind", "value").alias("x"))
    rows = rows.groupBy("click_id").agg(F.min("x").alias("x")).select("click_id", "x.*")
    day = F.unix_date(F.coalesce("arrived_at", "ts").cast("date")).cast("long")
    delay = F.greatest(F.lit(0), F.pmod(F.crc32(F.col("click_id").cast("string")), F.lit(30)) - 23)
    turn = F.pmod(day, F.lit(batches))
    event = micros("ts") - (day - turn) * (24 * HOUR_MS * 1000)
    rows = rows.select("click_id", F.coalesce("kind", F.lit("none")).alias("kind"), cents(F.col("value")).alias("cents"), F.least(F.lit(batches - 1), turn + F.coalesce(delay, F.lit(0))).cast("int").alias("batch"), event.alias("event"))
    return rows.select("batch", "click_id", "kind", F.expr("floor(event / 3600000000D)").cast("long").alias("hour"), F.expr("floor(event / 1000D)").cast("long").alias("event_ms"), "cents")


FILES = "click_id long, kind string, hour long, event_ms long, cents long"


def run_batch(spark: SparkSession, root: str, batch: int, w: int | None) -> None:
    """Start the query on the folders ``batch=0`` to ``batch``, of which only the last is new, and wait for its end."""
    path = f"{root}/in/batch={{{','.join(map(str, range(batch + 1)))}}}"
    rows = spark.readStream.schema(FILES).parquet(path)
    timed = rows.withColumn("at", F.timestamp_millis(F.col("event_ms") + SHIFT_MS)).withWatermark("at", "0 seconds")
    shard = 1 + F.pmod(F.xxhash64("click_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sums = timed.select("kind", "hour", "click_id", "cents", shard.alias("shard")).mapInArrow(combined(w), "kind string, day long, shard long, hour long, click_id long, n_rows long, cents long")
    out = sums.groupBy("kind", "day", "shard").transformWithState(Panes(batch), OUT, "Append", "EventTime")
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def unemitted(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The panes of the state that were never due, as records of ``batch``."""
    state = spark.read.format("statestore").option("stateVarName", "panes").load(f"{root}/state")
    found = state.select("key.kind", "user_map_key.hour", "user_map_value.*").where("NOT emitted")
    return found.select(F.lit(batch).cast("long").alias("batch"), "hour", F.lit(-1).cast("long").alias("click_id"), "n_rows", "cents", F.lit("final").alias("record"), "kind")


def revise_panes(clicks: DataFrame, batches: int = BATCHES, root: str | None = None) -> DataFrame:
    """batch, hour, click_id, n_rows, cents, record, kind of ``clicks`` (click_id, ts, arrived_at, kind, value), fed in ``batches`` batches.

    ``root``, a new folder under the shared one if not given, keeps the input, the state and the output; only the output is left in it.
    """
    spark = clicks.sparkSession
    root = root or f"{common.shared_dir(spark)}/panes-{uuid.uuid4().hex}"
    # a few files a core and batch, however many partitions the shuffle has
    staged(clicks, batches).coalesce(3 * spark.sparkContext.defaultParallelism).write.partitionBy("batch").parquet(f"{root}/in")
    largest = {r["batch"]: r["w"] for r in spark.read.schema(f"{FILES}, batch int").parquet(f"{root}/in").groupBy("batch").agg(F.max("event_ms").alias("w")).collect()}  # a row a batch
    w = None
    with settings(spark, STATE | QUICK):
        for k in range(batches):
            if k not in largest:
                spark.createDataFrame([], FILES).coalesce(1).write.parquet(f"{root}/in/batch={k}")
            run_batch(spark, root, k, w)
            w = max((x for x in (w, largest.get(k)) if x is not None), default=None)
        final = common.cut(unemitted(spark, root, batches - 1))
    for part in ("in", "state"):
        common.remove(spark, f"{root}/{part}")
    return spark.read.schema(OUT).parquet(f"{root}/out").unionByName(final)
