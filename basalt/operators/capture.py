"""Pages and threads to Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html_text

LAST = 9223372036854775807


def page_markdown(pages: DataFrame) -> DataFrame:
    """page_id, url, title, markdown of HTML pages. Fidelity: partial.

    A null page has null title and markdown; a page without a title has an empty one.
    """
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.select("page_id", "url", F.replace(title, F.lit("&amp;"), F.lit("&")).alias("title"), html_text(F.col("html")).alias("markdown"))


def thread_markdown(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, markdown: turns in order as ``**role**: text``. Fidelity: partial.

    A null role is ``unknown`` and a null text empty; turns without number come last; equal numbers go by role and text; a null conv_id is one thread.
    """
    line = F.concat(F.lit("**"), F.coalesce("role", F.lit("unknown")), F.lit("**: "), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("markdown"))


def qa_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: a user's turn and the assistant's directly after it, or null. Fidelity: partial.

    Turns without number come last, equal numbers go by role and text; a turn of null role is neither's.
    """
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    after = F.when(F.lead("role").over(by) == "assistant", F.lead("text").over(by))
    return turns.select("conv_id", "turn", "role", F.col("text").alias("question"), after.alias("answer")).where("role = 'user'").drop("role")
