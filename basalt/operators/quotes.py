"""Near-verbatim quotes: claims that a text gives with words changed, dropped or put in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bounded, row_keys

#: Words of a fingerprint, and fingerprints of which the smallest is kept.
GRAM = 3
WINDOW = 2
#: A run of so many equal words always holds a kept fingerprint.
SURE = GRAM + WINDOW - 1
ONE = 1 << 32


def allowed(n: Column) -> Column:
    """Errors that a quote of n words may have: so few that some run of SURE words stays whole, wherever they fall."""
    return F.floor((n - SURE) / (SURE + 1)).cast("int")


def least_seeds(n: Column, e: Column) -> Column:
    """Kept fingerprints that n words with e errors share at least: e + 1 whole runs hold n - e words, and each window of a run one."""
    return F.greatest(F.lit(1), F.ceil((n - e - (e + 1) * (GRAM + WINDOW - 2)) / WINDOW)).cast("int")


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))


def grams(hashes: Column) -> Column:
    """The fingerprint of the words at each place; none if there are too few."""

    def of(h):
        every = F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)]))
        return F.when(F.size(h) >= GRAM, every).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(hashes), of), 0)


def winnowed(fingerprints: Column) -> Column:
    """(at, h) of the smallest fingerprint of each window, the first of equal ones; a text of one short window keeps its smallest."""

    def smallest(g, i):
        some = F.slice(g, i + 1, F.lit(WINDOW))
        return (i + F.array_position(some, F.array_min(some)) - 1).cast("int")

    # the places don't go back as the window goes on, so equal ones stand together
    places = lambda g: F.transform(F.sequence(F.lit(0), F.greatest(F.size(g) - WINDOW, F.lit(0))), lambda i: smallest(g, i))
    once = lambda at: F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x))
    of = lambda g: F.transform(F.get(F.transform(F.array(places(g)), once), 0), lambda i: F.struct(i.alias("at"), F.get(g, i).alias("h")))
    none = F.array().cast("array<struct<at: int, h: bigint>>")
    return F.get(F.transform(F.array(fingerprints), lambda g: F.when(F.size(g) > 0, of(g)).otherwise(none)), 0)


def align(claim: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(errors, end, start) of the best place of ``claim`` in ``words``, of those whose words stand ``low`` to ``high`` places further on than in the claim.

    Fewest errors, then the first end, then the last start. A cell holds errors and, below them, the start; one row a
    word of the claim, one column a shift.
    """
    shift = np.arange(low, high + 1)
    far = np.int64(1 << 62)
    inside = (shift >= 0) & (shift <= len(words))
    cell = np.where(inside, ONE - 1 - np.clip(shift, 0, ONE - 1), far)
    steps = np.arange(len(shift), dtype=np.int64) * ONE
    for i, word in enumerate(claim):
        at = shift + i
        here = (at >= 0) & (at < len(words))
        same = np.zeros(len(shift), dtype=bool)
        same[here] = words[at[here]] == word
        changed = np.where(here, cell + np.where(same, 0, ONE), far)
        dropped = np.append(cell[1:] + ONE, far)
        best = np.minimum(changed, dropped)
        best = np.minimum.accumulate(best - steps) + steps  # words put in
        best[(at + 1 < 0) | (at + 1 > len(words))] = far
        cell = np.minimum(best, far)
    errors = cell >> 32
    k = int(np.argmin(errors))
    return int(errors[k]), int(shift[k]) + len(claim), int(ONE - 1 - (int(cell[k]) & (ONE - 1)))


def near_quotes(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, source, n_words, errors, first_word, n_quoted, first_char, end_char: the best place of each claim in each document that quotes it. Fidelity: partial (source as speaker).

    A document quotes a claim of n words, at least 4, if a stretch of it becomes the claim by at most (n - 4) / 5 words changed, dropped or put
    in. Words are runs of letters in lower case. Of several places the one of fewest errors is given, then of first end and last start, by its first word and number of words, and by its characters (from
    0, end exclusive).

    Documents keep the smaller of each two neighbouring fingerprints of three words, chosen by hash and so the same wherever a passage
    stands; claims, a stated query set, keep all. At the errors allowed some run of four words stays whole, and each holds a kept fingerprint, so
    no quote is lost; more: a quote's seeds lie within its errors of one diagonal, and their least number is known, so
    pairs with fewer seeds on a band of diagonals are left out. Only the bands that remain are aligned, over the words they cover.

    Null texts and claims quote nothing and are quoted by nothing; so do those of under four words (``said_verbatim`` has them). A null source or identifier stays; rows that repeat are rows of their own.
    """
    asked = claims.where("text IS NOT NULL").select("item_id", word_hashes(F.col("text")).alias("claim")).withColumn("n", F.size("claim")).where(F.col("n") >= SURE)
    asked = asked.withColumn("e", allowed(F.col("n"))).withColumn("least", least_seeds(F.col("n"), F.col("e")))
    asked = bounded(asked.withColumn("ask", F.monotonically_increasing_id()))
    wanted = bounded(asked.select("ask", "n", "e", "least", F.posexplode(grams(F.col("claim"))).alias("c", "h")))
    keys = row_keys("doc_id", "source", "text")
    texts = docs.where("text IS NOT NULL").select("doc_id", "source", "text")
    kept = texts.select(*keys, F.explode(winnowed(grams(word_hashes(F.col("text"))))).alias("x")).select("k1", "k2", F.col("x.at").alias("d"), F.col("x.h").alias("h"))
    width = 2 * F.col("e") + 1
    # each seed goes to two bands, twice as wide as a quote's diagonals, so that one holds them all
    seeds = kept.join(wanted, "h").withColumn("shift", F.col("d") - F.col("c"))
    seeds = seeds.withColumn("band", F.explode(F.array(F.floor(F.col("shift") / width), F.floor(F.col("shift") / width) - 1)))
    bands = seeds.groupBy("ask", "n", "e", "least", "k1", "k2", "band").agg(F.count(F.lit(1)).alias("seeds"), F.min("shift").alias("low"), F.max("shift").alias("high")).where("seeds >= least")
    found = bands.groupBy("ask", "k1", "k2").agg(F.collect_set(F.struct((F.col("low") - F.col("e")).alias("low"), (F.col("high") + F.col("e")).alias("high"))).alias("bands"))
    keyed = texts.select("doc_id", "source", "text", *keys)
    pairs = keyed.join(bounded(found), ["k1", "k2"]).join(asked.select("ask", "item_id", "claim", "n", "e"), "ask")
    rows = pairs.withColumn("words", word_hashes(F.col("text")))
    # only the words that a band covers go to the alignment
    spans = F.transform("bands", lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"), F.greatest(b["low"], F.lit(0)).alias("first"), F.slice(F.col("words"), F.greatest(b["low"], F.lit(0)) + 1, F.greatest(F.col("n") + b["high"] - F.greatest(b["low"], F.lit(0)), F.lit(0))).alias("part")))
    inputs = rows.select("item_id", "doc_id", "source", "text", "n", "e", "claim", spans.alias("spans"))
    kinds = {f.name: f.dataType.simpleString() for f in inputs.schema.fields}

    def work(batches):
        for b in batches:
            best = []
            for claim, spans in zip(b.column("claim"), b.column("spans").to_pylist(), strict=True):
                own = claim.values.to_numpy()
                every = []
                for s in spans:
                    errors, end, start = align(own, np.array(s["part"], dtype=np.int64), s["low"] - s["first"], s["high"] - s["first"])
                    every.append((errors, end + s["first"], -(start + s["first"])))
                best.append(min(every))
            columns = [b.column(c) for c in ("item_id", "doc_id", "source", "text", "n", "e")]
            errors, ends, starts = (pa.array([x[k] for x in best], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([*columns, errors, ends, starts], names=["item_id", "doc_id", "source", "text", "n", "e", "errors", "end", "start"])

    placed = inputs.mapInArrow(work, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, source {kinds['source']}, text string, n int, e int, errors long, end long, start long").where("errors <= e")
    first, n = -F.col("start"), F.col("end") + F.col("start")
    chunks = F.regexp_extract_all("text", F.lit(r"\P{L}*\p{L}+"), F.lit(0))
    upto = lambda k: F.aggregate(F.slice("chunks", F.lit(1), k.cast("int")), F.lit(0).cast("long"), lambda t, x: t + F.length(x))
    letters = F.length(F.regexp_extract(F.get("chunks", first.cast("int")), r"\p{L}+", 0))
    return placed.withColumn("chunks", chunks).select(
        "item_id", "doc_id", "source", F.col("n").cast("long").alias("n_words"), "errors", first.alias("first_word"), n.alias("n_quoted"), (upto(first + 1) - letters).alias("first_char"), upto(F.col("end")).alias("end_char")
    )


def said_nearly(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, source, n_docs, n_changed, fewest_errors: documents of a source that quote the claim, how many not word by word, and the closest. Fidelity: stand-in (source as speaker).

    Cases as in ``near_quotes``; a null source is one source.
    """
    found = near_quotes(claims, docs)
    return found.groupBy("item_id", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("errors") > 0).alias("n_changed"), F.min("errors").alias("fewest_errors"))
