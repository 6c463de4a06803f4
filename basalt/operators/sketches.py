"""Sketches that are kept by day and merged over days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct-count sketch, and three times its relative standard error, which is what is stated.
LG_K = 14
STATED = 3 * 1.04 / 2 ** (LG_K / 2)
#: Size of a quantile sketch, and the error in rank that it states.
K = 400
RANK = 0.01


def daily_sketches(rows: DataFrame, key: str = "client_id", kind: str = "kind", at: str = "ts", value: str = "value") -> DataFrame:
    """day, kind, n, clients (a HyperLogLog sketch of the keys), amounts (a KLL sketch of the values): to be stored, a row a day and kind.

    Sketches form in the map tasks and merge on the way; none holds more than its fixed size. Rows without time are left out; null keys and values, and values that are no number, are in no sketch.
    """
    known = rows.where(F.col(at).isNotNull()).select(F.col(at).cast("date").alias("day"), F.coalesce(kind, F.lit("none")).alias("kind"), F.col(key).cast("long").alias("key"), F.when(~F.isnan(value), F.col(value)).alias("value"))
    return known.groupBy("day", "kind").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("key", LG_K).alias("clients"), F.kll_sketch_agg_double("value", F.lit(K)).alias("amounts"))


def merged(daily: DataFrame) -> DataFrame:
    """kind, n, n_days, clients of all days of ``daily``."""
    return daily.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_days"), F.hll_union_agg("clients", True).alias("clients"))


def sketched_activity(rows: DataFrame, key: str = "client_id", kind: str = "kind", at: str = "ts", value: str = "value") -> DataFrame:
    """kind, n, n_days, n_clients, clients_within, n_medians_within: a kind's rows and exact number of clients, whether the sketches of its days, merged, are within the stated error of it, and on how many days
    the sketch's median is a value whose exact rank is within the stated error. Fidelity: stand-in.

    The stated errors are three standard errors of a distinct count, and a hundredth of a rank. A kind without clients is within; a day without values counts as within. Cases as in ``daily_sketches``.
    """
    daily = daily_sketches(rows, key, kind, at, value)
    median = F.when(F.coalesce(F.kll_sketch_get_n_double("amounts"), F.lit(0)) > 0, F.kll_sketch_get_quantile_double("amounts", F.lit(0.5)))
    known = rows.where(F.col(at).isNotNull()).select(F.col(at).cast("date").alias("day"), F.coalesce(kind, F.lit("none")).alias("kind"), F.col(key).alias("key"), F.when(~F.isnan(value), F.col(value)).alias("value"))
    medians = daily.select("day", "kind", median.alias("median"))
    # the exact rank needs the values once more, beside their day's median: a row a day and kind, joined on both
    ranked = known.join(medians, ["day", "kind"]).groupBy("day", "kind").agg(F.count("value").alias("c"), F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("upto"))
    good = (F.col("c") == 0) | ((F.col("below") <= (0.5 + RANK) * F.col("c") + 1) & (F.col("upto") >= (0.5 - RANK) * F.col("c") - 1))
    days = ranked.groupBy("kind").agg(F.count_if(good).alias("n_medians_within"))
    exact = known.groupBy("kind").agg(F.countDistinct("key").alias("n_clients"))
    estimate = F.hll_sketch_estimate("clients")
    found = merged(daily.select("kind", "n", "clients")).join(exact, "kind").join(days, "kind")
    return found.select("kind", "n", "n_days", "n_clients", (F.abs(estimate - F.col("n_clients")) <= F.lit(STATED) * F.col("n_clients") + 1).alias("clients_within"), "n_medians_within")
