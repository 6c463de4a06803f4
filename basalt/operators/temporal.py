"""Rows in time: as-of and interval joins, and frames over a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import epoch_micros

HOUR = 3_600_000_000


def _timed(rows: DataFrame, key: str, kind: str, at: str, id_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.coalesce(kind, F.lit("none")).alias("kind"), epoch_micros(at).alias("us"))


def last_of_another_kind(rows: DataFrame, key: str = "client_id", kind: str = "kind", at: str = "ts", id_col: str = "click_id", bucket: int = HOUR) -> DataFrame:
    """click_id, kind, other_id, other_kind, gap_us: each row and its key's last one of another kind before it, by time, then identifier. Fidelity: stand-in.

    An as-of join without a join of the rows: where the kind changes, the row before is the last of another kind, and stays so until the
    next change. Within a key and hour that is a window; what stood at the end of earlier hours is carried over by a window of at most
    two rows an hour, so a key that holds a third of all rows is split by time.

    Rows without key or time have no other, and are nobody's other; a null kind is ``none``; of rows of equal time the
    smaller identifier is the earlier, null first; rows that repeat are rows of their own, of one kind and so not each other's.
    """
    timed = _timed(rows, key, kind, at, id_col)
    known = timed.where("key IS NOT NULL AND us IS NOT NULL").withColumn("bucket", F.floor(F.col("us") / bucket))
    order = ["us", F.col("id").asc_nulls_first(), "kind"]
    event = F.struct("us", "id", "kind")
    here = Window.partitionBy("key", "bucket").orderBy(*order)
    turned = known.withColumn("before", F.lag(event).over(here))
    turned = turned.withColumn("own", F.last(F.when(F.col("before.kind") != F.col("kind"), F.col("before")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    # the last row of each hour, and the last of another kind than it
    ends = turned.groupBy("key", "bucket").agg(F.max(F.struct("us", "id", "kind", "own")).alias("x"))
    hours = Window.partitionBy("key").orderBy("bucket")
    ends = ends.select("key", "bucket", F.struct("x.us", "x.id", "x.kind").alias("last"), F.col("x.own").alias("own")).withColumn("earlier", F.lag("last").over(hours))
    ends = ends.withColumn("other", F.last(F.coalesce("own", F.when(F.col("earlier.kind") != F.col("last.kind"), F.col("earlier"))), ignorenulls=True).over(hours.rowsBetween(Window.unboundedPreceding, 0)))
    carried = ends.select("key", "bucket", "earlier", F.lag("other").over(hours).alias("other"))
    joined = turned.join(carried, ["key", "bucket"])
    found = F.coalesce("own", F.when(F.col("earlier.kind") != F.col("kind"), F.col("earlier")).otherwise(F.col("other")))
    joined = joined.withColumn("found", found).select(F.col("id").alias(id_col), "kind", F.col("found.id").alias("other_id"), F.col("found.kind").alias("other_kind"), (F.col("us") - F.col("found.us")).alias("gap_us"))
    rest = timed.where("key IS NULL OR us IS NULL").select(F.col("id").alias(id_col), "kind", F.lit(None).cast("long").alias("other_id"), F.lit(None).cast("string").alias("other_kind"), F.lit(None).cast("long").alias("gap_us"))
    return joined.unionByName(rest)


def within(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Pairs of rows of ``left`` and ``right`` (each key, us, further columns of different names) of one key, the right one at most ``reach`` microseconds before or at the same time.

    Time is cut in stretches of the reach. A right row stands in its own and the next one, so each pair meets in just one, by an equi-join on key and
    stretch, which splits a hot key by time.
    """
    stretch = lambda df: df.where("key IS NOT NULL AND us IS NOT NULL").withColumn("stretch", F.floor(F.col("us") / reach))
    twice = stretch(right).withColumn("stretch", F.explode(F.array("stretch", F.col("stretch") + 1))).withColumnRenamed("us", "right_us")
    return stretch(left).join(twice, ["key", "stretch"]).where(F.col("right_us").between(F.col("us") - reach, F.col("us"))).drop("stretch")


def errors_before_purchases(rows: DataFrame, key: str = "client_id", kind: str = "kind", at: str = "ts", id_col: str = "click_id", reach: int = HOUR) -> DataFrame:
    """purchase_id, error_id, gap_us: errors that a client met within the hour before a purchase. Fidelity: stand-in.

    Rows without key or time meet none; rows that repeat are rows of their own; null identifiers stay.
    """
    timed = _timed(rows, key, kind, at, id_col)
    purchases = timed.where("kind = 'purchase'").select("key", "us", F.col("id").alias("purchase_id"))
    errors = timed.where("kind = 'error'").select("key", "us", F.col("id").alias("error_id"))
    return within(purchases, errors, reach).select("purchase_id", "error_id", (F.col("us") - F.col("right_us")).alias("gap_us"))


def recent_activity(rows: DataFrame, key: str = "client_id", kind: str = "kind", at: str = "ts", id_col: str = "click_id", reach: int = HOUR) -> DataFrame:
    """click_id, n_same, n_other: rows of the client within the hour up to each row, of its kind (itself included) and of others. Fidelity: stand-in.

    Range frames over time, a key and stretch of time at a time: each row also stands in the next stretch, as what the frames there look back on.
    Rows without key or time count none; a null kind is ``none``; rows that repeat are rows of their own.
    """
    timed = _timed(rows, key, kind, at, id_col)
    known = timed.where("key IS NOT NULL AND us IS NOT NULL").withColumn("stretch", F.floor(F.col("us") / reach))
    known = known.withColumn("at", F.explode(F.array("stretch", F.col("stretch") + 1)))
    back = lambda *by: Window.partitionBy("key", "at", *by).orderBy("us").rangeBetween(-reach, 0)
    counted = known.select("id", "stretch", "at", F.count(F.lit(1)).over(back("kind")).alias("n_same"), F.count(F.lit(1)).over(back()).alias("n_all"))
    counted = counted.where("at = stretch").select(F.col("id").alias(id_col), "n_same", (F.col("n_all") - F.col("n_same")).alias("n_other"))
    rest = timed.where("key IS NULL OR us IS NULL").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_same"), F.lit(0).cast("long").alias("n_other"))
    return counted.unionByName(rest)


def calendar(daily: DataFrame, by: str, day: str, counts: dict[str, Column]) -> DataFrame:
    """``daily`` (by, day and counts) with a row for each day from the first to the last of its ``by``; ``counts``: what stands in the missing ones."""
    span = daily.where(F.col(day).isNotNull()).groupBy(by).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    days = span.select(F.col(by).alias("__by"), F.explode(F.sequence("first", "last")).alias("__day"))
    met = days.join(daily, F.col("__by").eqNullSafe(F.col(by)) & (F.col("__day") == F.col(day)), "left")
    return met.select(F.col("__by").alias(by), F.col("__day").alias(day), *[F.coalesce(c, missing).alias(c) for c, missing in counts.items()])


def activity_baseline(rows: DataFrame, kind: str = "kind", at: str = "ts", days: int = 7) -> DataFrame:
    """day, kind, n, n_before, n_days, mean, deviation: a kind's rows of each day, of the day before, and how far the day stands from the days before it. Fidelity: stand-in (no dated text).

    Days without rows, between a kind's first and last, count 0. The frame is the ``days`` days before, as many as the calendar has (n_days); mean and standard
    deviations from it (null if the days are alike) are rounded to six places. Rows without time are left out; a null kind is a kind.
    """
    daily = rows.where(F.col(at).isNotNull()).groupBy(F.col(kind).alias("kind"), F.col(at).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    full = calendar(daily, "kind", "day", {"n": F.lit(0).cast("long")}).withColumn("number", F.unix_date("day"))
    by = Window.partitionBy("kind").orderBy("number")
    frame = by.rangeBetween(-days, -1)
    full = full.select("day", "kind", "n", F.first("n").over(by.rangeBetween(-1, -1)).alias("n_before"), F.count(F.lit(1)).over(frame).alias("c"), F.sum("n").over(frame).alias("s"), F.sum(F.col("n") * F.col("n")).over(frame).alias("q"))
    spread = F.col("c") * F.col("q") - F.col("s") * F.col("s")
    deviation = F.when(spread > 0, F.round((F.col("n") * F.col("c") - F.col("s")) / F.sqrt(spread.cast("double")), 6))
    return full.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "kind", "n", "n_before", F.col("c").alias("n_days"), F.round(F.col("s") / F.when(F.col("c") > 0, F.col("c")), 6).alias("mean"), deviation.alias("deviation"))
