"""Mixing sources to target weights.

Tokens (words) are summed per source, each source gets a target from its weight, and the target
over the source's own size is its repetition rate. A document is then emitted floor(rate) times,
plus once more with probability equal to the fraction, decided by a hash of seed and identifier, so
that reruns agree and no random state is held. Sums pre-aggregate in the map tasks, thus a source
with a third of all rows is no hot group; the table of sources joins back by broadcast if counted
small, by a skew-splitting shuffle join otherwise.

Targets: the sources, by code point and null last, weigh 1, 2, 3, 1, ...; they share the total size.
No target exceeds ``max_repeat`` times its source's size; the excess goes to the others by weight until
none is above. That is the level L at which sum(min(cap, L * weight)) is the total, found by sharing what the capped
sources leave among the others again, as often as that caps one more. Sources may be many: they are ranked by a
range-partitioned sort, and each sharing is one sum over their table; no task holds all of them.

Defined cases: null text has size 0; null source is one source; null identifiers share one coin;
repeated rows are separate rows with the same coin; an empty table gives an empty result; the added
columns replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ADDED = ["size", "source_size", "target", "copies"]


def word_count(text: F.Column) -> F.Column:
    return F.regexp_count(common.body(text), F.lit(common.WORD_RE)).cast("long")


def ranked(per: DataFrame) -> DataFrame:
    """``per`` with rank, from 0, of its sources, null last; in cut form."""
    dealt = per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    # within a partition the number rises by one a row, in its lower 33 bits
    placed = common.cut(dealt.withColumn("__n", F.monotonically_increasing_id()))
    part, at = F.shiftright("__n", 33), F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
    counts, before = {}, 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        counts[r["part"]], before = before, before + r["count"]
    offsets = placed.sparkSession.createDataFrame(list(counts.items()), "part long, before long")
    return common.cut(placed.join(F.broadcast(offsets), part == F.col("part")).withColumn("rank", F.col("before") + at).drop("__n", "part", "before"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """source, source_size, target from rows of source, size."""
    per = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", max_repeat * F.col("source_size"))
    level, capped, total = F.lit(0.0), -1, per.agg(F.sum("source_size")).head()[0] or 0
    below = F.lit(False)
    while True:
        x = per.agg(F.count_if(below).alias("n"), F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0)).alias("cap"), F.sum(F.when(~below, F.col("weight"))).alias("weight")).head()
        if x["n"] == capped or not x["weight"]:
            break
        capped, level = x["n"], float(total - x["cap"]) / float(x["weight"])
        below = F.col("cap") < F.lit(level) * F.col("weight")
        level = F.lit(level)
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def coin(seed: str, identifier: F.Column) -> F.Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, in cut form, so that words are counted once."""
    return common.cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))


def plan_sizes(rows: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, id_col: str = "doc_id", source_col: str = "source", given: DataFrame | None = None) -> DataFrame:
    """Rows that have their size with source_size, target and copies; targets come from ``given`` (source, size) if it is there."""
    given = rows.select(F.col(source_col).alias("source"), "size") if given is None else given
    targets = common.cut(source_targets(given, weights, max_repeat)).select(F.col("source").alias("__source"), "source_size", "target")
    # a name may be long, so its bytes count
    held = targets.agg(F.sum(F.coalesce(F.octet_length("__source"), F.lit(0)) + 64)).head()[0] or 0
    targets = common.checked_broadcast(targets, 1, held)
    kept = [c for c in rows.columns if c not in ("source_size", "target", "copies")]
    rows = rows.join(targets, rows[source_col].eqNullSafe(targets["__source"]), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = coin(seed, F.col(id_col)) < rate - F.floor(rate)
    return rows.withColumn("copies", F.floor(rate) + extra.cast("long")).select(*kept, "source_size", "target", "copies")


def plan_mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents with size, source_size, target and copies (how often the mix takes each)."""
    kept = [c for c in docs.columns if c not in ADDED]
    given = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = common.with_columns_of(docs, kept).withColumn("size", word_count(F.col(text_col)))
    return plan_sizes(rows, seed, weights, max_repeat, id_col, source_col, given).select(*kept, *ADDED)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document repeated ``copies`` times, in the columns of ``docs``."""
    planned = plan_mix(docs, **options).where("copies > 0")
    own = [c for c in planned.columns if c not in ADDED]
    return planned.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*own)
