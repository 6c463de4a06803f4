"""An inverted index that is kept, and ranked search that reads only the parts of it that can matter."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import FUNCTION_WORDS, bounded, tokens
from ..sources import removed, shared_dir, written

#: Documents whose postings of a word stand together, with their largest weight beside them.
BLOCK = 64
#: Blocks that a query reads first, to learn what a document must score.
FIRST = 16


def _packed(block: int):
    """Batches of documents as postings: the words of each stretch of ``block`` documents, named by its first one's number, with the documents that hold them."""

    def work(batches):
        for batch in batches:
            lists = batch.column("words")
            words, parents = lists.flatten().dictionary_encode(), lists.value_parent_indices().to_numpy()
            if not len(words):
                continue
            # a number for a stretch, word and document, of which equal ones are a posting
            code, n, size = words.indices.to_numpy().astype("i8"), batch.num_rows, len(words.dictionary)
            key, tf = np.unique(((parents // block) * size + code) * n + parents, return_counts=True)
            at, group = key % n, key // n
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = pa.array(np.append(start, len(key)), pa.int32())
            rows = batch.column("row").to_numpy()
            held = [batch.column("row").take(pa.array(at)), batch.column("doc_id").take(pa.array(at)), pa.array(tf.astype("i4")), batch.column("length").take(pa.array(at))]
            first = rows[(group[start] // size) * block]
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(group[start] % size)), pa.array(first), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(held, ["row", "doc_id", "tf", "length"]))], ["word", "block", "rows"])

    return work


def _value(x: Column, mean: Column, k1: float, b: float) -> Column:
    return x["tf"] * (k1 + 1) / (x["tf"] + k1 * (1 - b + b * x["length"] / mean))


def build(docs: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, block: int = BLOCK) -> None:
    """Write the index of ``docs`` (doc_id, text) to ``path``: ``postings`` (word, block, rows of row, doc_id, tf, length) and ``heads`` (word, block, top, n, idf and BM25's mean, k1, b).

    Weights are those of BM25. Documents are numbered as they are read, and a block is a stretch of numbers within a batch. A task makes the postings of its
    blocks, so they are sent once, evenly, and stand sorted by word within files; what holds for a word follows from the heads. A reader's filter on words skips row groups.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", tokens(F.col("text")).alias("words")).select("row", "doc_id", "words", F.size("words").alias("length"))
    blocks = numbered.where("length > 0").mapInArrow(_packed(block), f"word string, block long, rows array<struct<row: bigint, doc_id: {kind}, tf: int, length: int>>")
    blocks.repartition("word", "block").sortWithinPartitions("word", "block").write.parquet(f"{path}/postings")
    kept = docs.sparkSession.read.parquet(f"{path}/postings")
    n = docs.count()
    words = kept.agg(F.sum(F.aggregate("rows", F.lit(0).cast("long"), lambda s, x: s + x["tf"]))).head()[0] or 0
    mean = F.lit(words / n if words else 1.0)
    heads = kept.select("word", "block", F.array_max(F.transform("rows", lambda x: _value(x, mean, k1, b))).alias("most"), F.size("rows").alias("n"))
    df = F.sum("n").over(Window.partitionBy("word"))
    heads = heads.withColumn("idf", F.ln(1 + (n - df + 0.5) / (df + 0.5)))
    heads = heads.select("word", "block", (F.col("most") * F.col("idf")).alias("top"), "n", "idf", mean.alias("mean"), F.lit(k1).alias("k1"), F.lit(b).alias("b"))
    heads.sortWithinPartitions("word", "block").write.parquet(f"{path}/heads")


def _scores(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """ask, item_id, row, doc_id, score of the documents of ``wanted`` (ask, item_id, word, block, idf, mean, k1, b)."""
    rows = spark.read.parquet(f"{path}/postings").join(wanted, ["word", "block"]).select("ask", "item_id", "idf", "mean", "k1", "b", F.explode("rows").alias("x"))
    tf = F.col("x.tf")
    weight = F.col("idf") * tf * (F.col("k1") + 1) / (tf + F.col("k1") * (1 - F.col("b") + F.col("b") * F.col("x.length") / F.col("mean")))
    return rows.groupBy("ask", "item_id", "x.row", "x.doc_id").agg(F.round(F.sum(weight), 6).alias("score"))


def search(spark: SparkSession, path: str, asked: DataFrame, k: int = 5, first: int = FIRST) -> tuple[DataFrame, dict[str, int]]:
    """item_id, rank, doc_id, score of the k best documents for each query of ``asked`` (item_id, text), a stated query set; how many postings its words have and how many were read.

    A block can hold no document that scores more than the largest weights of the query's words in it together. The blocks of highest such bound are read
    first; the k-th best score found there, less what rounding may hide, is what any other must reach, so blocks whose bound is below it are never read.
    """
    stop = sorted({w for v in FUNCTION_WORDS.values() for w in v})
    # queries of one identifier, null too, are one, as in ``search_ranked``
    terms = asked.select(F.xxhash64("item_id").alias("ask"), "item_id", F.explode(F.array_distinct(F.filter(tokens(F.col("text")), lambda w: ~w.isin(stop)))).alias("word"))
    terms = bounded(terms)
    # a word's heads are kept once, however many queries ask it
    heads = written(spark.read.parquet(f"{path}/heads").join(bounded(terms.select("word").distinct()), "word")).join(terms, "word")
    limits = written(heads.groupBy("ask", "block").agg(F.sum("top").alias("most")))
    # Spark keeps each task's first ones only, so the blocks of a query don't meet in one task
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("most"), "block"))
    ahead = written(limits.withColumn("place", place).where(F.col("place") <= first).select("ask", "block"))
    of = lambda blocks: heads.select("ask", "item_id", "word", "block", "idf", "mean", "k1", "b").join(blocks.select("ask", "block"), ["ask", "block"])
    begun = written(_scores(spark, path, bounded(of(ahead))))
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "doc_id")
    reach = begun.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).groupBy("ask").agg(F.max("at").alias("at"), (F.min("score") - 1e-5).alias("reach")).where(F.col("at") == k)
    rest = limits.join(bounded(ahead), ["ask", "block"], "left_anti").join(bounded(reach.select("ask", "reach")), "ask", "left").where("reach IS NULL OR most >= reach")
    rest = written(of(rest))
    found = begun.unionByName(_scores(spark, path, bounded(rest)))
    ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
    count = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    taken = ahead.unionByName(rest.select("ask", "block").distinct())
    return ranked, {"postings": count(heads), "read": count(heads.join(taken, ["ask", "block"]))}


def search_indexed(asked: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """item_id, rank, doc_id, score: as ``search_ranked``, over an index that is built, asked and removed. Fidelity: partial.

    Cases as there. To keep an index between runs, ``build`` it once and ``search`` it.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    try:
        build(docs, path)
        return written(search(spark, path, asked, k)[0])
    finally:
        removed(spark, path)
