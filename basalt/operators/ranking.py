"""Ranking and communities of what pages link to, by message passing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bounded
from ..sources import written

#: Rounds of ``authorities``, and the most that ``communities`` takes before it says that labels still change.
ROUNDS = 8
MOST = 64


def links(pages: DataFrame) -> DataFrame:
    """page_id, target: the different targets of each page's plain links."""
    return pages.where("page_id IS NOT NULL").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a href="([^"]*)">'), F.lit(1))).alias("target")).distinct()


def authorities(pages: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """target, n_pages, authority: what is linked to, by the pages that do and how much else of weight they link to. Fidelity: stand-in.

    Hubs and authorities: a target's authority is the sum of its pages' weights as hubs, a page's weight the sum of its targets' authority, ``rounds``
    times, each time scaled so that the largest is 1. Sums form in the map tasks, so a target that a third of all pages link to meets a task as a
    row a task; a round's messages are written, and only the largest value goes to the driver. Authority is rounded to six places.

    Null pages link nowhere; rows that repeat a page are one page with the links of all.
    """
    edges = written(links(pages))
    scaled = lambda df, c: df.withColumn(c, F.col(c) / F.lit(df.agg(F.max(c)).head()[0] or 1.0))
    hubs = edges.select("page_id").distinct().withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        found = scaled(written(edges.join(hubs, "page_id").groupBy("target").agg(F.sum("weight").alias("authority"))), "authority")
        hubs = scaled(written(edges.join(found, "target").groupBy("page_id").agg(F.sum("authority").alias("weight"))), "weight")
    counts = edges.groupBy("target").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.join(found, "target").select("target", "n_pages", F.round("authority", 6).alias("authority"))


def communities(pages: DataFrame, below: int = 4, most: int = MOST) -> DataFrame:
    """page_id, community, n_pages: pages that hang together by targets of at most ``below`` pages, by the smallest page of each community. Fidelity: stand-in.

    Common targets, such as a site's navigation, tie nothing. Each round a page takes the smallest label among the pages that share a target with it, and then the label
    of that label, so labels travel twice as far each time; it ends when none changes. A page without such a target is its own community.

    Null pages have no row; rows that repeat a page are one page.
    """
    edges = links(pages)
    rare = edges.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, below)).select("target")
    edges = written(edges.join(bounded(rare), "target"))
    labels = written(pages.where("page_id IS NOT NULL").select("page_id").distinct().withColumn("community", F.col("page_id")))
    for _ in range(most):
        heard = edges.join(labels, "page_id").groupBy("target").agg(F.min("community").alias("least"))
        offered = edges.join(heard, "target").groupBy("page_id").agg(F.min("least").alias("least"))
        nearer = labels.join(offered, "page_id", "left").select("page_id", F.col("community").alias("old"), F.least("community", "least").alias("community"))
        nearer = written(nearer)
        # the label's own label
        jumped = nearer.join(nearer.select(F.col("page_id").alias("community"), F.col("community").alias("next")), "community").select("page_id", "old", F.least("community", "next").alias("community"))
        jumped = written(jumped)
        labels = jumped.select("page_id", "community")
        if jumped.where("old <> community").isEmpty():
            sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n_pages"))
            return labels.join(sizes, "community").select("page_id", "community", "n_pages")
    raise RuntimeError(f"labels still change after {most} rounds")
