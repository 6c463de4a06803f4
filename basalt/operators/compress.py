"""Text without its function words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import CHINESE_FUNCTION_WORDS, bounded, content_words, tokens
from ..sources import written
from .segment import HAN, STRETCH, lexicon, segmented, stretch_counts

#: Entropy of what stands beside a Chinese function word, above which the corpus shows it as a word of its own.
ALONE = 1.0


def _chinese(docs: DataFrame) -> DataFrame:
    """id, compressed of Chinese texts (id, text): their runs of Han without the function words that stand as words of their own.

    Words come from the texts themselves (``segment``): a function word goes where the likeliest series of words of a run holds it
    alone, if the corpus shows that it stands freely. So 和 goes, but not from 和平 once that is seen to be a word; a corpus too
    small to tell keeps all.
    """
    runs = written(stretch_counts(docs, HAN))
    words = written(lexicon(runs))
    free = [r["word"] for r in words.where(F.col("word").isin(CHINESE_FUNCTION_WORDS) & (F.col("freedom") >= ALONE)).select("word").collect()]  # of a fixed list
    kept = segmented(runs.select("run"), words).select("run", F.array_join(F.filter("words", lambda w: ~w.isin(free)), "").alias("kept"))
    parts = docs.select("id", F.posexplode(tokens(F.col("text"))).alias("p", "token")).select("id", "p", F.posexplode(F.regexp_extract_all("token", F.lit(f"{HAN}{{1,{STRETCH}}}|[^{HAN}]+"), F.lit(0))).alias("q", "run"))
    parts = parts.join(bounded(kept), "run", "left").select("id", "p", "q", F.coalesce("kept", "run").alias("part"))
    joined = lambda order, glue: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "part"))), lambda x: x["part"]), glue)
    bare = parts.groupBy("id", "p").agg(joined("q", "").alias("part")).where(F.length("part") > 0)
    return bare.groupBy("id").agg(joined("p", " ").alias("compressed"))


def _compressed(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_before (characters), compressed."""
    rows = docs.select("doc_id", "lang", "text")
    plain = lambda df: df.select("doc_id", "lang", F.length("text").alias("n_before"), F.array_join(content_words(F.col("text"), F.col("lang")), " ").alias("compressed"))
    chinese = F.coalesce((F.col("lang") == "zh") & F.col("text").rlike(HAN), F.lit(False))
    if rows.where(chinese).isEmpty():
        return plain(rows)
    own = written(rows.where(chinese).withColumn("id", F.monotonically_increasing_id()))
    found = own.join(_chinese(own), "id", "left").select("doc_id", "lang", F.length("text").alias("n_before"), F.coalesce("compressed", F.lit("")).alias("compressed"))
    return plain(rows.where(~chinese)).unionByName(found)


def strip_function_words(docs: DataFrame) -> DataFrame:
    """doc_id, lang, compressed. Fidelity: partial (lists of function words; Chinese words found from the texts; the test data hold no Chinese).

    Null text stays null; a null or other language has no function words. Chinese, of language ``zh``, loses function words that are words of their own where the corpus is large enough to show it.
    """
    return _compressed(docs).select("doc_id", "lang", "compressed")


def compression_stats(docs: DataFrame) -> DataFrame:
    """lang, n_docs, chars_before, chars_after, ratio. Fidelity: partial, as ``strip_function_words``.

    Null text counts as a document without characters; a null language is one row; the ratio is null where there is nothing before.
    """
    sums = _compressed(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_before").alias("chars_before"), F.sum(F.length("compressed")).alias("chars_after"))
    return sums.withColumn("ratio", F.round(F.col("chars_after") / F.nullif(F.col("chars_before"), F.lit(0)), 6))
