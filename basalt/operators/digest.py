"""Digests of many sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import BROADCAST_BYTES, FUNCTION_WORDS, bounded, shingle_hashes, tokens, weighed
from ..sources import written

#: Scores of a batch's documents that a task holds at once, unless one query has more.
CELLS = 1 << 20


def source_digest(docs: DataFrame) -> DataFrame:
    """source, lang, level, n_docs, n_distinct, chars with totals (level 0 both, 1 source, 3 all). Fidelity: partial.

    Null texts are documents, but no distinct text and without characters; null sources and languages are groups of their own, told from
    totals by their level; an empty table gives no row of totals.
    """
    rows = docs.select("source", "lang", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    # copies fold first, so that the distinct count over three levels carries one row a text
    folded = rows.groupBy("source", "lang", "h").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    return folded.rollup("source", "lang").agg(F.grouping_id().cast("long").alias("level"), F.sum("c").alias("n_docs"), F.countDistinct("h").alias("n_distinct"), F.sum("n").alias("chars"))


def dedupe_exact(docs: DataFrame) -> DataFrame:
    """doc_id, source of the lowest doc_id of each distinct text. Fidelity: partial.

    Null texts are one text. Of rows that repeat a doc_id the lower source is taken, null first.
    """
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("doc_id", "source")).alias("x"))
    return first.select("x.doc_id", "x.source")


def _hash_sets(docs: DataFrame) -> DataFrame:
    """row, id, s, n: each different set of shingle hashes (ascending) and its lowest doc_id, written to shared storage.

    Equal sets are found by two hashes of the whole set, so that sets stay where they are while the lowest are few. Rows may
    repeat a doc_id and text, so each has a number of its own.
    """
    texts = docs.groupBy(F.sha2("text", 256).alias("t")).agg(F.min("doc_id").alias("doc_id")).where("t IS NOT NULL").select("doc_id").distinct()
    first = docs.select("doc_id", "text").join(bounded(texts), "doc_id")
    # no filter passes the number, so none makes the sets once more
    sets = first.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), F.sort_array(shingle_hashes(tokens(F.col("text")))).alias("s")).where(F.size("s") > 0)
    kept = written(sets.select("row", "id", "s", F.size("s").alias("n"), F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("second"), "s").alias("h2")))
    lowest = bounded(kept.groupBy("h1", "h2").agg(F.min(F.struct("id", "row"))["row"].alias("row")).select("row"))
    return kept.join(lowest, "row").select("row", "id", "s", "n")


def _frequent(reps: DataFrame, one_in: int = 16, least: int = 4, top: int = 1 << 15, bits: int = 1 << 18) -> Callable[[Column], Column]:
    """A test of shingle hashes: true for the ``top`` most frequent ones found in ``least`` or more of one in ``one_in`` sets.

    It is a bit array, 32 KB in the plan, so a few others pass too. It only orders shingles, and any order gives the same result.
    """
    some = reps.where(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0).select(F.explode("s").alias("h"))
    counts = some.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(top)
    word = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(bits // 64 - 1)).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    found = dict(counts.groupBy(word(F.col("h")).alias("at")).agg(F.bit_or(bit(F.col("h"))).alias("bits")).collect())
    held = F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>")  # folded to a constant
    return lambda h: F.get(held, word(h)).bitwiseAND(bit(h)) != 0


def _of_pairs(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that stand in a pair ra, rb."""
    return reps.join(bounded(pairs.select(F.explode(F.array("ra", "rb")).alias("row")).distinct()), "row")


def _parities(sets: DataFrame) -> DataFrame:
    """row, id, bits: 1024 bits, each the parity of the number of hashes that fall on it. Two sets' bits differ in no more places than the sets in hashes."""
    spread = sets.select("row", "id", F.explode("s").alias("h")).withColumn("word", F.shiftright("h", 6).bitwiseAND(F.lit(15)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    words = spread.groupBy("row", "id").agg(*[F.coalesce(F.bit_xor(F.when(F.col("word") == k, bit)), F.lit(0).cast("long")).alias(f"w{k}") for k in range(16)])
    return words.select("row", "id", F.array(*[f"w{k}" for k in range(16)]).alias("bits"))


def near_duplicates(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """a, b, jaccard between representatives of equal shingle sets. Fidelity: partial.

    A set's representative is its lowest doc_id; ``near_duplicate_members`` gives the others'. Texts that are null or under five tokens are in no pair. Under any one order of the
    shingles, sets of that similarity share one of their first n - ceil(least * n) + 1, so only those are joined on. The
    order puts shingles that a sample of the sets finds frequent last, so that a passage which many documents hold
    gives few pairs; the sample decides the order alone, never the result. Of the pairs, only those go on to
    the comparison of whole sets whose shared first shingles, and all behind the last of these, could suffice, and whose
    bits of parity don't differ in more places than the sets may.
    """
    reps = _hash_sets(docs)
    late = _frequent(reps)
    ordered = F.concat(F.filter("s", lambda h: ~late(h)), F.filter("s", late))
    first = F.slice(ordered, F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))
    prefix = reps.select("row", "n", F.posexplode(first).alias("at", "h"))
    x, y = prefix.alias("x"), prefix.alias("y")
    met = x.join(y, "h").where(F.expr(f"x.row < y.row AND least(x.n, y.n) >= {least} * greatest(x.n, y.n)"))
    met = met.groupBy(F.col("x.row").alias("ra"), F.col("y.row").alias("rb"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count(F.lit(1)).alias("c"), F.max("x.at").alias("xa"), F.max("y.at").alias("ya"))
    most = F.col("c") + F.least(F.col("na") - F.col("xa"), F.col("nb") - F.col("ya")) - 1
    # the bound is loosened by one, as it is in floating point
    pairs = written(met.where((most + 1) * (1 + least) >= least * (F.col("na") + F.col("nb"))).select("ra", "rb", "na", "nb"))
    bits = written(_parities(_of_pairs(reps, pairs)))
    differ = F.aggregate(F.zip_with("ba", "bb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    left, right = [bits.select(F.col("row").alias(f"r{k}"), F.col("id").alias(f"i{k}"), F.col("bits").alias(f"b{k}")) for k in "ab"]
    pairs = pairs.join(left, "ra").join(right, "rb").where("ia <> ib")
    pairs = written(pairs.where(differ * (1 + least) <= (F.col("na") + F.col("nb")) * (1 - least) + 1).select("ra", "rb", "ia", "ib"))
    last = _of_pairs(reps, pairs)
    left, right = [last.select(F.col("row").alias(f"r{k}"), F.col("s").alias(f"s{k}")) for k in "ab"]
    both = F.size(F.array_intersect("sa", "sb"))
    scored = pairs.join(left, "ra").join(right, "rb").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= least).withColumn("jaccard", F.round("jaccard", 6))


def near_duplicate_members(docs: DataFrame) -> DataFrame:
    """doc_id, rep: each document with a shingle and its representative in ``near_duplicates``, itself if it is the lowest. Fidelity: partial.

    Null texts and texts without a shingle have no row.
    """
    sets = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sort_array(shingle_hashes(tokens(F.col("text")))).alias("s")).where(F.size("s") > 0)
    kept = written(sets.select("row", "doc_id", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("second"), "s").alias("h2")))
    several = kept.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return kept.join(bounded(several), ["h1", "h2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))


def search_top(docs: DataFrame, term: str = "the", k: int = 3) -> DataFrame:
    """source, doc_id, tf, rank: a source's k documents in which a word occurs most. Fidelity: partial.

    Ties go by doc_id, null first; a null source is one source; null texts have no word.
    """
    hits = docs.select("source", "doc_id", F.size(F.filter(tokens(F.col("text")), lambda w: w == term)).cast("long").alias("tf")).where("tf > 0")
    by = Window.partitionBy("source").orderBy(F.desc("tf"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _held(words: Broadcast):
    """Batches of documents with their number of words and, for those in ``words``, the place there and how often each comes."""

    def work(batches):
        size = max(1, len(words.value))
        for batch in batches:
            lists = batch.column("words")
            every = lists.flatten()
            code = pc.index_in(every, value_set=words.value.cast(every.type))
            # a number for a document and word
            key = lists.value_parent_indices().to_numpy()[code.is_valid().to_numpy(zero_copy_only=False)] * size + code.drop_null().to_numpy()
            key, tf = np.unique(key, return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * size), pa.int32())
            counts = [pa.ListArray.from_arrays(ends, pa.array(x.astype("i4"))) for x in (key % size, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists.value_lengths().fill_null(0), *counts], ["doc_id", "length", "held", "tf"])

    return work


def _best(model: Broadcast, k: int, k1: float, b: float):
    """Batches of such documents as each query's ``k`` best of a batch: item_id, doc_id, score, ties by doc_id.

    Stretches of queries are scored against the whole batch, a word's documents being added to the queries that ask it.
    """

    def work(batches):
        items, ends, words, times, idf, mean = model.value
        for batch in batches:
            n, lists = batch.num_rows, batch.column("held")
            if not n:
                continue
            order = pc.array_sort_indices(batch.column("doc_id"), null_placement="at_start").to_numpy()
            place = np.empty(n, "i8")
            place[order] = np.arange(n)
            of, word, tf = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
            weight = idf[word] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * batch.column("length").to_numpy()[of] / mean))
            by = np.argsort(word, kind="stable")
            doc, weight, first = place[of[by]], weight[by], np.searchsorted(word[by], np.arange(len(idf) + 1))
            step = max(1, CELLS // n)
            for low in range(0, len(items), step):
                part = ends[low : low + step + 1]
                asked = words[part[0] : part[-1]]
                size = first[asked + 1] - first[asked]
                at = np.repeat(first[asked] - np.cumsum(size) + size, size) + np.arange(size.sum())
                ask = np.repeat(np.repeat(np.arange(len(part) - 1), np.diff(part)), size)
                score = np.bincount(ask * n + doc[at], weight[at] * np.repeat(times[part[0] : part[-1]], size), (len(part) - 1) * n).reshape(-1, n)
                # weights are above 0, so a document without a word of the query alone has 0
                score = np.where(score > 0, np.floor(score * 1e6 + 0.5), -1)
                least = np.partition(score, n - k, axis=1)[:, n - k, None] if n > k else 0
                q, d = np.nonzero((score >= least) & (score >= 0))
                turn = np.lexsort((d, -score[q, d], q))
                turn = turn[np.arange(len(q)) - np.searchsorted(q, q) < k]
                q, d = q[turn], d[turn]
                yield pa.RecordBatch.from_arrays([items.take(pa.array(low + q)), batch.column("doc_id").take(pa.array(order[d])), pa.array(score[q, d] / 1e6)], ["item_id", "doc_id", "score"])

    return work


def _searched(asks: DataFrame, docs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """item_id, doc_id, score: the best of each batch of ``docs`` for ``asks`` (item_id, terms of word and times), which go to every task."""
    context, kinds = docs.sparkSession.sparkContext, [x.schema[name].dataType.simpleString() for x, name in ((asks, "item_id"), (docs, "doc_id"))]
    table = asks.toArrow()
    terms = table.column("terms").combine_chunks()
    word, times = [pc.struct_field(terms.flatten(), name) for name in ("word", "times")]
    word = word.dictionary_encode()
    words = context.broadcast(word.dictionary)
    # the one pass over texts; all else follows from what it keeps
    held = written(docs.select("doc_id", tokens(F.col("text")).alias("words")).mapInArrow(_held(words), f"doc_id {kinds[1]}, length int, held array<int>, tf array<int>"))
    total = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).head()
    df = np.zeros(len(word.dictionary))
    for at, n in held.select(F.explode("held").alias("word")).groupBy("word").count().collect():
        df[at] = n
    idf = np.log(1 + (total["n"] - df + 0.5) / (df + 0.5))
    ends = np.append(0, np.cumsum(terms.value_lengths().to_numpy()))
    model = context.broadcast((table.column("item_id").combine_chunks(), ends, word.indices.to_numpy(), times.to_numpy(), idf, total["mean"] or 1.0))
    found = written(held.mapInArrow(_best(model, k, k1, b), f"item_id {kinds[0]}, doc_id {kinds[1]}, score double"))
    for x in (words, model):
        x.unpersist()
    return found


def search_ranked(asked: DataFrame, docs: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest BM25 score for each query's words. Fidelity: partial.

    ``asked``: item_id, text, a stated query set. Words are distinct tokens that are no function word of any language. Documents count as
    often as they come, and null texts as documents without a word; ties in the score, rounded to six places, go by doc_id.
    Documents are counted and scored in the tasks that read them, and only each query's best of a batch are sent on. Queries go to the tasks
    in parts of about ``BROADCAST_BYTES``, each with a pass over the documents; a query stays whole, so one with more than that goes alone or with others.
    """
    stop = sorted({w for v in FUNCTION_WORDS.values() for w in v})
    terms = asked.select("item_id", F.explode(F.array_distinct(F.filter(tokens(F.col("text")), lambda w: ~w.isin(stop)))).alias("word")).groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("times"))
    asks, size = weighed(terms.groupBy("item_id").agg(F.collect_list(F.struct("word", "times")).alias("terms")))
    parts = size // BROADCAST_BYTES + 1
    found = reduce(DataFrame.unionByName, [_searched(asks.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i), docs, k, k1, b) for i in range(parts)])
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def digest_markdown(docs: DataFrame, term: str = "the") -> DataFrame:
    """source, markdown: a section per source of counts and top documents. Fidelity: partial (layout).

    A null source is the section ``unknown``; null texts are documents without characters; a null doc_id is written ``none``.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    line = F.concat(F.lit("- document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(": "), "tf")
    top = search_top(docs, term).groupBy(F.col("source").alias("of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    text = F.concat(F.lit("## "), F.coalesce("source", F.lit("unknown")), F.lit("\n\n"), "n_docs", F.lit(" documents, "), "chars", F.lit(f" characters\n\nMost `{term}`:\n"), F.coalesce("lines", F.lit("- none")))
    return counts.join(top, F.col("source").eqNullSafe(F.col("of")), "left").select("source", text.alias("markdown"))


def activity_track(events: DataFrame) -> DataFrame:
    """day, event_type, n, delta: daily counts and the change from the day before, which counts 0 if it has none of the type. Fidelity: stand-in (no dated text).

    Events without time are a day of their own, null, with a null delta; a null type is one type; a type's first day has a null delta.
    """
    daily = events.groupBy(F.col("ts").cast("date").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("event_type").orderBy(F.unix_date("d"))
    before = F.coalesce(F.first("n").over(by.rangeBetween(-1, -1)), F.lit(0))
    first = F.min("d").over(Window.partitionBy("event_type"))
    return daily.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "event_type", "n", F.when(F.col("d") > first, F.col("n") - before).alias("delta"))
