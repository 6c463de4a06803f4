"""Edges as Mermaid text. Labels are quoted, as link targets may hold commas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links_mermaid(pages: DataFrame) -> DataFrame:
    """page_id, mermaid: a page's navigation links, in order. Fidelity: partial (rendering).

    A null page has none; a null url is written ``unknown``.
    """
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a href="([^"]*)">'), F.lit(1))
    lines = F.transform(targets, lambda t, i: F.concat(F.lit('  p --> n'), i.cast("string"), F.lit('["'), t, F.lit('"]')))
    return pages.select("page_id", F.array_join(F.concat(F.array(F.concat(F.lit('graph LR\n  p["'), F.coalesce("url", F.lit("unknown")), F.lit('"]'))), lines), "\n").alias("mermaid"))


def hierarchy_mermaid(region: DataFrame, nation: DataFrame) -> DataFrame:
    """r_regionkey, mermaid: a region's nations as a tree. Fidelity: partial (rendering).

    Null names are written ``unknown``; nations without region or key are left out; a region without nations is a tree of its own.
    """
    line = F.concat(F.lit("  r --> n"), "n_nationkey", F.lit('["'), F.coalesce("n_name", F.lit("unknown")), F.lit('"]'))
    nations = nation.where("n_nationkey IS NOT NULL").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    head = F.concat(F.lit('graph TD\n  r["'), F.coalesce("r_name", F.lit("unknown")), F.lit('"]'))
    return region.join(nations, "r_regionkey", "left").select("r_regionkey", F.concat_ws("\n", head, "lines").alias("mermaid"))
