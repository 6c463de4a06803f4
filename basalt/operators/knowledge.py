"""Short fragments: cleaning, keywords, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bounded, content_words
from ..sources import written


def fragments(docs: DataFrame, below: int = 200) -> DataFrame:
    """doc_id, lang, clean of texts under ``below`` characters. Fidelity: partial.

    A null length is no fragment; a null text stays null.
    """
    return docs.where(F.col("n_chars") < below).select("doc_id", "lang", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("clean"))


def fragment_keywords(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, rank, word, n: a fragment's k most frequent content words. Fidelity: partial.

    Ties go by the word; rows that repeat a doc_id are one fragment; null texts have no word.
    """
    words = fragments(docs).select("doc_id", F.explode(content_words(F.col("clean"), F.col("lang"))).alias("word"))
    counts = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).select("doc_id", "rank", "word", "n")


def fragment_links(docs: DataFrame, most: int = 256) -> DataFrame:
    """doc_id, linked_doc, n_shared, same_set: every link of fragments that share two keywords or more. Fidelity: partial.

    Fragments of equal keyword sets (two words or more) form a class, represented by its lowest doc_id. Rows with ``same_set``
    give each other fragment of a class its representative; the others are all links between representatives, the lower
    doc_id second; fragments without a doc_id are left out. Two fragments are thus linked if and only if they are of one class or their classes are linked.

    Classes meet by pair of keywords, and of the pairs that two share only the lowest counts, so no link is made twice. A
    pair that more than ``most`` classes hold is dealt in parts: its left rows by hash, its right rows to each part.
    """
    words = written(fragment_keywords(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list("word")).alias("words")).where(F.size("words") > 1))
    classes = written(words.groupBy("words").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("c")))
    several = classes.where("c > 1").select("words", F.col("id").alias("linked_doc"))
    members = words.join(bounded(several), "words").where("doc_id <> linked_doc").select("doc_id", "linked_doc", F.size("words").cast("long").alias("n_shared"), F.lit(True).alias("same_set"))
    pairs = F.flatten(F.transform("words", lambda x: F.transform(F.filter("words", lambda y: y > x), lambda y: F.array(x, y))))
    rows = classes.select("id", "words", F.explode(pairs).alias("pair"))
    parts = rows.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(bounded(parts), "pair", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = rows.select("pair", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("doc_id"), "words")
    right = rows.select("pair", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("linked_doc"), F.col("words").alias("other"))
    met = left.join(right, ["pair", "part"]).where("doc_id > linked_doc").withColumn("both", F.array_intersect("words", "other"))
    links = met.where(F.slice("both", 1, 2) == F.col("pair")).select("doc_id", "linked_doc", F.size("both").cast("long").alias("n_shared"), F.lit(False).alias("same_set"))
    return links.unionByName(members)


def fragment_link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, n_links: each fragment of two keywords or more, the lowest doc_id with its keywords, and how many others share two of its keywords or more. Fidelity: partial.

    No link is made: with N(T) the fragments that hold all words of T, those that share two words or more with a set S
    are the sum over its subsets T of two or more words of (-1)^|T| (|T| - 1) N(T). A fragment has five words, so 26 subsets at most, and counts
    pre-aggregate; work and rows grow with the fragments, however many links they have. Fragments without a doc_id are left out.
    """
    words = fragment_keywords(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list("word")).alias("words")).where(F.size("words") > 1)
    words = written(words)
    classes = written(words.groupBy("words").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    subset = lambda mask: F.filter("words", lambda w, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("words")) - 1)
    some = classes.select("class_id", "class_size", F.explode(F.filter(F.transform(masks, subset), lambda t: F.size(t) > 1)).alias("t"))
    held = some.groupBy("t").agg(F.sum("class_size").alias("n"))
    sign = F.when(F.size("t") % 2 == 0, 1).otherwise(-1)
    met = some.join(held, "t").groupBy("class_id").agg((F.sum(sign * (F.size("t") - 1) * F.col("n")) - 1).alias("n_links"))
    return words.join(classes.join(met, "class_id"), "words").select("doc_id", "class_id", "class_size", "n_links")
