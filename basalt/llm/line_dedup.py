"""Line deduplication against levelled sorted runs of line hashes.

A store holds runs: Parquet tables of (128-bit hash of a line's key, owner document), bucketed by hash and each bucket sorted
by it. A batch pre-aggregates its lines by hash, merge-joins each run bucket by bucket, for which no run is shuffled or sorted
again, keeps what no run holds and adds
that as a run of level 0; when a level has ``fanout`` runs they are merged into one run of the next level.
A key belongs to the document that first brought it; within a batch, to the smallest identifier. A whole
corpus is taken as batches of ascending identifiers, so a key belongs to its smallest identifier. There is one batch
more than ``fanout``, so that runs are merged at any size, and one more for each doubling beyond ``BATCH_ROWS`` rows.

Only hashes are shuffled. A line that stands in a third of all documents becomes one row a map task before
the shuffle by hash, and the join that finds its losing places is an ordinary shuffle join that Spark splits
at run time. What is lost is gathered per document as positions, and texts are cut in place.

Defined cases: null and empty text is one empty line; a null identifier counts as the largest; rows that
repeat an identifier count as one document for ownership and keep their own texts; an empty table gives an
empty result; the added columns replace columns of the same names.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ADDED = ["n_lines", "n_dropped"]
NO_ID = 9223372036854775807
BATCH_ROWS = 250_000


def line_key(line: F.Column) -> F.Column:
    """Stripped of white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(common.TRIM_CHARS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, common.UPPER, common.LOWER))


def row_hash(text: F.Column) -> F.Column:
    return F.xxhash64(text)


def hashed_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """doc, rid, pos, h1, h2 of each line that may be dropped."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), common.body(F.col(text_col)).alias("text"))
    lines = rows.select("doc", row_hash(F.col("text")).alias("rid"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "rid", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc", "rid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineStore:
    """Levelled runs under one shared folder. The folder's names tell level and buckets, so a store can be opened again."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{common.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> dict[int, list[str]]:
        """Folders of finished runs by level; an unfinished write has no _SUCCESS and doesn't count."""
        at, fs = self._fs()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found: dict[int, list[str]] = {}
        if fs.exists(at):
            for s in fs.listStatus(at):
                name = s.getPath().getName()
                if name.startswith("level") and fs.exists(path(s.getPath(), "_SUCCESS")):
                    found.setdefault(int(name[5:].split("-")[0]), []).append(s.getPath().toString())
        return {k: sorted(v) for k, v in sorted(found.items())}

    @staticmethod
    def _name(folder: str) -> str:
        return "lines_" + folder.rsplit("-", 1)[1]

    def table(self, folder: str) -> DataFrame:
        """A run as a bucketed table of the session, made known to it if another session wrote it."""
        if not self.spark.catalog.tableExists(self._name(folder)):
            n = int(folder.rsplit("-", 2)[1])
            self.spark.sql(f"CREATE TABLE {self._name(folder)} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {n} BUCKETS LOCATION '{folder}'")
        return self.spark.table(self._name(folder))

    def add(self, rows: DataFrame, level: int = 0) -> None:
        """Write one run, a file a bucket."""
        folder = f"{self.path}/level{level}-{self.buckets}-{uuid.uuid4().hex}"
        dealt = rows.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", folder).saveAsTable(self._name(folder))

    def compact(self) -> None:
        level = 0
        while len(folders := self.runs().get(level, [])) >= self.fanout:
            merged = self.table(folders[0])
            for f in folders[1:]:
                merged = merged.unionByName(self.table(f))
            self.add(merged.groupBy("h1", "h2").agg(F.min("owner").alias("owner")), level + 1)
            for f in folders:
                self.forget(f)
                common.remove(self.spark, f)
            level += 1

    def absorb(self, lines: DataFrame) -> DataFrame:
        """Take a batch (doc, h1, h2, ...): its lines that lose to another document, and a new run."""
        judged = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        owners = [F.lit(None).cast("long")]
        for k, folder in enumerate(f for level in self.runs().values() for f in level):
            judged = judged.join(self.table(folder).withColumnRenamed("owner", f"owner{k}").hint("merge"), ["h1", "h2"], "left")
            owners.append(F.col(f"owner{k}"))
        judged = judged.withColumn("owner", F.coalesce(*owners))
        judged = judged.select("h1", "h2", F.col("owner").isNull().alias("new"), F.coalesce("owner", "first").alias("owner"), "last", "first")
        with common.settings(self.spark, {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}):
            judged = common.cut(judged.select("h1", "h2", "new", "owner", ((F.col("last") != F.col("owner")) | (F.col("first") != F.col("owner"))).alias("contested")))
        self.add(judged.where("new"))
        self.compact()
        return lines.join(judged.where("contested").select("h1", "h2", "owner"), ["h1", "h2"]).where("doc != owner")

    def forget(self, folder: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(folder)}")

    def drop(self) -> None:
        for folders in self.runs().values():
            for f in folders:
                self.forget(f)
        common.remove(self.spark, self.path)


def batches_for(rows: int, fanout: int) -> int:
    return fanout + 1 + max(0, math.ceil(math.log2(max(rows, 1) / BATCH_ROWS)))


def lost_positions(docs: DataFrame, batches: int | None, min_chars: int, id_col: str, text_col: str, store: LineStore | None) -> tuple[DataFrame, int]:
    """doc, rid, lost (ascending positions) of documents that lose lines, and their count of bytes."""
    spark = docs.sparkSession
    runs = store or LineStore(spark)
    batches = batches or batches_for(docs.count(), runs.fanout)
    folder = f"{common.shared_dir(spark)}/hashes-{uuid.uuid4().hex}"
    try:
        bounds = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 1000).alias("b")).head()["b"] if batches > 1 else []
        bounds = sorted(set(bounds or []))
        batch = sum((F.col("doc") > b).cast("int") for b in bounds) if bounds else F.lit(0)
        hashed_lines(docs, min_chars, id_col, text_col).withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
        lines = spark.read.schema("doc long, rid long, pos int, h1 long, h2 long, batch int").parquet(folder)
        lost = [runs.absorb(lines.where(F.col("batch") == b).drop("batch")).select("doc", "rid", "pos") for b in range(len(bounds) + 1)]
        every = lost[0]
        for more in lost[1:]:
            every = every.unionByName(more)
        per = common.cut(every.groupBy("doc", "rid").agg(F.array_sort(F.collect_set("pos")).alias("lost")))
    finally:
        common.remove(spark, folder)
        if store is None:
            runs.drop()
    size = per.agg(F.sum(F.size("lost") * 4 + 64)).head()[0] or 0
    return per, size


def keep_lines(lines: F.Column, lost: F.Column) -> F.Column:
    """The lines but those at ``lost`` (ascending), by a string of flags, in time linear in both."""
    gap = lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.when(i > 0, F.get(lost, i - 1)).otherwise(F.lit(-1)) - 1), F.lit("1"))
    flags = F.split(F.array_join(F.transform(lost, gap), ""), "")
    return F.filter(F.arrays_zip(lines.alias("line"), flags.alias("flag")), lambda z: ~F.coalesce(z["flag"], F.lit("0")).eqNullSafe("1"))


def dedup_lines(docs: DataFrame, batches: int | None = None, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", store: LineStore | None = None) -> DataFrame:
    """``docs`` with their kept text, n_lines (before) and n_dropped."""
    own = [c for c in docs.columns if c not in ADDED]
    lost, size = lost_positions(docs, batches, min_chars, id_col, text_col, store)
    lost = common.checked_broadcast(lost.select(F.col("doc").alias("__doc"), F.col("rid").alias("__rid"), F.col("lost").alias("__lost")), 1, size)
    rows = common.with_columns_of(docs, own).withColumn("__text", common.body(F.col(text_col)))
    rows = rows.join(lost, (F.coalesce(rows[id_col].cast("long"), F.lit(NO_ID)) == lost["__doc"]) & (row_hash(rows["__text"]) == lost["__rid"]), "left")
    lines = F.split("__text", "\n", -1)
    kept = F.array_join(F.transform(keep_lines(lines, F.col("__lost")), lambda z: z["line"]), "\n")
    return rows.withColumns(
        {
            text_col: F.when(F.col("__lost").isNull(), F.col("__text")).otherwise(kept),
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.when(F.col("__lost").isNull(), F.lit(0)).otherwise(F.size("__lost")).cast("long"),
        }
    ).select(*own, *ADDED)
