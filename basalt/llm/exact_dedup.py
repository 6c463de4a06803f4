"""Exact deduplication over a keyed state that streaming keeps on disk.

Each text's SHA-256 keys one state row which holds the number of copies, the stable identifier
that stays (the largest) and the locator of its content (file and row). The state is a streaming
aggregation in RocksDB without watermark, so no key expires; a further run over the same state
folder reads only new files. Copies pre-aggregate in the map tasks, so a digest that holds a third
of all rows reaches its state partition as one row a task.

A digest is only a claim: every row that hits another's digest is compared byte by byte with
the text that stays. Rows that differ there (a collision) are regrouped by their full text.

Defined cases: a null text is the empty text; rows without identifier count, are compared and get
the identifier that stays in their group, null if none has one; rows that repeat an identifier stay
separate rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import settings

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files at ``path``, a folder or one file.

    A file stream takes its path as the base folder of partitions unless it is a pattern, so a
    single file is given as a pattern that only its own name matches.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).parquet(path)


def absorb(stream: DataFrame, state_dir: str, digest=sha256, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Run all that ``stream`` (a file stream) has not yet given through the state at ``state_dir``."""
    spark = stream.sparkSession
    rows = stream.select(
        digest(common.body(F.col(text_col))).alias("digest"),
        F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
    )
    state = rows.groupBy("digest").agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("n"))
    with settings(spark, STATE):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        query.awaitTermination()


def held(spark: SparkSession, state_dir: str) -> DataFrame:
    """The state: digest, keep_id, file, row, n."""
    with settings(spark, STATE):
        state = spark.read.format("statestore").load(state_dir)
        return state.select(
            F.col("key.digest").alias("digest"), F.col("value.max.id").alias("keep_id"), F.col("value.max.file").alias("file"),
            F.col("value.max.row").alias("row"), F.col("value.count").alias("n"),
        )


def resolve(docs: DataFrame, state: DataFrame, digest=sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for each row, after the comparison of bytes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), common.body(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
    shared = common.cut(state.where("n > 1").select("digest", "keep_id", "file", "row", "n"))
    shared = common.checked_broadcast(shared, shared.count(), 160)
    located = docs.select(
        F.col(id_col).alias("doc_id"), common.body(F.col(text_col)).alias("kept_text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    kept_texts = located.join(shared.select("file", "row", "digest", "keep_id", "n"), ["file", "row"]).select("digest", "kept_text", "keep_id", "n")
    alone = rows.join(shared.select("digest"), "digest", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", F.sha2("text", 256).alias("text_sha256"))
    hits = rows.join(shared.select("digest"), "digest", "left_semi")
    compared = hits.join(kept_texts, "digest").select(
        "doc_id", "digest", "keep_id", "n", (F.col("text") == F.col("kept_text")).alias("same"), F.when(F.col("text") != F.col("kept_text"), F.col("text")).alias("other"), F.sha2("text", 256).alias("text_sha256"),
    )
    compared = common.cut(compared)
    differing = compared.where(~F.col("same"))
    if not differing.isEmpty():
        return alone.unionByName(_regroup(compared, differing))
    return alone.unionByName(compared.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "text_sha256"))


def _regroup(compared: DataFrame, differing: DataFrame) -> DataFrame:
    """Groups of one digest that hold several texts: the rows that differ group by full text."""
    other = differing.groupBy("digest", "other").agg(F.max("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
    less = differing.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    first = compared.where("same").join(less, "digest", "left").select(
        "doc_id", "keep_id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "text_sha256"
    )
    rest = differing.drop("keep_id", "n").join(other, ["digest", "other"]).select(
        "doc_id", F.col("own_keep").alias("keep_id"), F.col("own_n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("own_keep")).alias("kept"), "digest", "text_sha256"
    )
    return first.unionByName(rest)


def exact_dedup(spark: SparkSession, path: str, state_dir: str | None = None, digest=sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate the Parquet table at ``path``; ``state_dir`` keeps the state between runs."""
    own = None if state_dir else f"{common.shared_dir(spark)}/exact-{uuid.uuid4().hex}"
    state_dir = state_dir or own
    docs = spark.read.parquet(path)
    try:
        absorb(file_stream(spark, path, docs.schema), state_dir, digest, id_col, text_col)
        return resolve(docs, held(spark, state_dir), digest, id_col, text_col)
    finally:  # the result reads what was cut from the state
        if own:
            common.remove(spark, own)
