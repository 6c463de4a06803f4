"""Claims against a corpus: lexical presence, never truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import SHINGLE, bounded, measured, row_keys, shingle_hashes, tokens
from ..sources import written

#: A claim without a word that must stand whole is looked for by its first characters.
START = 3


def _asked(claims: DataFrame) -> tuple[DataFrame, bool]:
    """ask (a number), item_id, claim, shingles, n (tokens of the inner run, null if there is none) and inner (its hash); whether they are few bytes."""
    words = tokens(F.col("text"))
    length = F.least(F.size(words) - 2, F.lit(SHINGLE))
    run = lambda n: F.get(shingle_hashes(F.slice(words, F.lit(2), F.lit(n)), n), 0)
    inner = F.coalesce(*[F.when(length == n, run(n)) for n in range(1, SHINGLE + 1)])
    return measured(claims.select(F.monotonically_increasing_id().alias("ask"), "item_id", F.col("text").alias("claim"), shingle_hashes(words).alias("shingles"), F.when(length > 0, length).alias("n"), inner.alias("inner")))


def _met(asked: tuple[DataFrame, bool], docs: DataFrame, runs: bool, shared: bool) -> DataFrame:
    """What claims and documents have in common, after one pass over the documents' tokens: ask, item_id, n_claim, doc_id, source, k1, k2, shared (a shingle of the claim), inner (its inner run)."""
    rows, few = asked
    of = lambda keys, a, b: rows.select("ask", "item_id", F.greatest(F.size("shingles"), F.lit(0)).alias("n_claim"), F.explode(keys).alias("key"), F.lit(a).alias("shared"), F.lit(b).alias("inner"))
    wanted = of(F.when(F.lit(shared), F.col("shingles")), True, False).unionByName(of(F.when(F.lit(runs) & F.col("inner").isNotNull(), F.array("inner")), False, True))
    wanted = wanted.groupBy("ask", "item_id", "n_claim", "key").agg(F.max("shared").alias("shared"), F.max("inner").alias("inner"))
    lengths = {r["n"] for r in rows.where("n IS NOT NULL").select("n").distinct().collect()} if runs else set()  # five at most
    lengths = sorted(lengths | ({SHINGLE} if shared or not lengths else set()))
    every = F.get(F.transform(F.array(tokens(F.col("text"))), lambda w: F.array_distinct(F.concat(*[shingle_hashes(w, n) for n in lengths]))), 0)
    spread = docs.select("doc_id", "source", *row_keys("doc_id", "source", "text"), F.explode(every).alias("key"))
    return spread.join(F.broadcast(wanted) if few else wanted, "key").drop("key")


def _containing(asked: tuple[DataFrame, bool], met: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, source of documents that contain a claim's whole text, from what ``_met`` found.

    A claim's inner tokens, all but the first and the last, stand whole in any text that contains it, so an equi-join on a run of up to five
    of them finds the candidates, whose texts alone are looked into. Claims of under three tokens, which have no inner one, are a stated query set and broadcast if counted few bytes; if
    not, they meet the documents by their first characters.
    """
    rows, few = asked
    said = rows.where("claim IS NOT NULL").select("ask", "item_id", "claim", "n")
    texts = docs.where("text IS NOT NULL").select("doc_id", "source", "text", *row_keys("doc_id", "source", "text"))
    candidates = met.where("inner").select("ask", "k1", "k2").distinct()
    short = said.where("n IS NULL").drop("n")
    if few:
        brief = texts.join(F.broadcast(short), F.contains("text", "claim"))
    else:
        starts = F.array_distinct(F.concat(F.array(F.lit("")), *[F.transform(F.sequence(F.lit(1), F.length("text") - k + 1), lambda i: F.substr(F.col("text"), i, F.lit(k))) for k in range(1, START + 1)]))  # noqa: B023
        some = texts.withColumn("start", F.explode(F.when(F.length("text") >= START, starts).otherwise(_short_starts(F.col("text"))))).drop("text")
        near = some.join(short.withColumn("start", F.substring("claim", 1, START)), "start").select("ask", "k1", "k2").distinct()
        brief = texts.join(near, ["k1", "k2"]).join(short, "ask").where(F.contains("text", "claim"))
    long = texts.join(bounded(candidates), ["k1", "k2"]).join(F.broadcast(said) if few else said, "ask").where(F.contains("text", "claim"))
    return long.select("item_id", "doc_id", "source").unionByName(brief.select("item_id", "doc_id", "source"))


def _short_starts(text: Column) -> Column:
    """All stretches of a text of under START characters."""
    return F.array_distinct(F.array(F.lit(""), *[F.substring(text, i, k) for k in range(1, START) for i in range(1, START - k + 1)]))


def containing(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, source of documents that contain a claim's whole text."""
    asked = _asked(claims)
    return _containing(asked, _met(asked, docs, runs=True, shared=False), docs)


def said_verbatim(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, source, n_docs: documents of a source that contain the whole claim. Fidelity: stand-in (source as speaker).

    Null texts and claims contain nothing and are in nothing; an empty claim is in every text; a null source is one source.
    """
    return containing(claims, docs).groupBy("item_id", "source").agg(F.count(F.lit(1)).alias("n_docs"))


def _counted(met: DataFrame) -> DataFrame:
    return met.where("shared").groupBy("item_id", "doc_id", "source", "n_claim").agg(F.count(F.lit(1)).alias("n_shared"))


def _shared(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, source, n_shared, n_claim: distinct shingles that claim and document share."""
    return _counted(_met(_asked(claims), docs, runs=False, shared=True))


def said_overlap(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, source, best_shared: most distinct shingles shared with one document of the source. Fidelity: stand-in.

    Null texts and texts under five tokens share nothing; a null source is one source.
    """
    return _shared(claims, docs).groupBy("item_id", "source").agg(F.max("n_shared").alias("best_shared"))


def evidence(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, n_shared, coverage. Fidelity: partial.

    Null texts and texts under five tokens share nothing.
    """
    return _shared(claims, docs).select("item_id", "doc_id", "n_shared", F.round(F.col("n_shared") / F.col("n_claim"), 6).alias("coverage"))


def check_report(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, n_docs, n_sources, best_coverage, support for every claim. Fidelity: partial.

    ``support`` is verbatim (a document contains the whole claim), partial (one shares a shingle) or none_found. A null claim is none_found; without documents all are. A null source counts as no source.
    """
    asked = _asked(claims)
    met = written(_met(asked, docs, runs=True, shared=True))  # the documents' tokens are spread once
    found = _counted(met).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.max(F.round(F.col("n_shared") / F.col("n_claim"), 6)).alias("best_coverage"))
    whole = _containing(asked, met, docs).select("item_id", F.lit(True).alias("whole")).distinct()
    rows = claims.select("item_id").join(found, "item_id", "left").join(whole, "item_id", "left")
    support = F.when(F.col("whole"), "verbatim").when(F.col("n_docs") > 0, "partial").otherwise("none_found")
    return rows.select("item_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_docs", "n_sources")], F.coalesce("best_coverage", F.lit(0.0)).alias("best_coverage"), support.alias("support"))


def echoed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_said, n_echoed: a turn's distinct shingles, and how many a turn of another role said before it. Fidelity: stand-in (role as speaker).

    Turns without a conversation or a number are left out; a null role echoes nobody and nobody echoes it; null texts say nothing; turns of
    equal number don't precede one another. A shingle meets only the first turn that each role said it in, so a phrase that a conversation
    repeats makes no pairs.
    """
    rows = written(turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", shingle_hashes(tokens(F.col("text"))).alias("s")).withColumn("id", F.monotonically_increasing_id()))
    said = rows.where("role IS NOT NULL").select("id", "conv_id", "turn", "role", F.explode("s").alias("shingle"))
    first = said.groupBy("conv_id", "shingle", F.col("role").alias("by")).agg(F.min("turn").alias("at"))
    met = said.join(first, ["conv_id", "shingle"]).where("by <> role AND at < turn").select("id", "shingle").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(met, "id", "left").select("conv_id", "turn", "role", F.greatest(F.coalesce(F.size("s"), F.lit(0)), F.lit(0)).cast("long").alias("n_said"), F.coalesce("n", F.lit(0)).alias("n_echoed"))
