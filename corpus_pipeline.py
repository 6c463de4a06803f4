"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
Documents lost by a stage: those without a letter or of no clear language (language ID), all but one of each
group of near copies, and what the target weights leave out of a source (mixing, which also repeats documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import common, lang_id, line_dedup, mixing, near_dedup, packing

#: Documents whose calibrated score is below this have no clear language.
CLEAR = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a clear language. Learned from labelled rows outside the held-out fold."""
    model = lang_id.fit(docs.where(~lang_id.held_out()).select("doc_id", "text", "lang"))
    found = lang_id.identify(docs.withColumnsRenamed({c: f"__{c}" for c in lang_id.ADDED if c in docs.columns}), model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= CLEAR)).drop(*lang_id.ADDED)
    return kept.withColumnsRenamed({f"__{c}": c for c in lang_id.ADDED if c in docs.columns}).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed({c: f"__{c}" for c in line_dedup.ADDED if c in docs.columns})).drop(*line_dedup.ADDED)
    kept = kept.withColumnsRenamed({f"__{c}": c for c in line_dedup.ADDED if c in docs.columns})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest identifier."""
    gone = common.cut(near_dedup.near_dedup(docs).where(~F.col("kept")).select("doc_id"))
    return docs.join(common.checked_broadcast(gone, gone.count(), 32), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    clash = {c: f"__{c}" for c in mixing.ADDED if c in docs.columns}
    mixed = mixing.mix_sources(docs.withColumnsRenamed(clash))
    return mixed.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids."""
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None  # language ID is a fitted model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is checkpointed before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
