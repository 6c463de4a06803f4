"""Extractive briefings: the sentences of a source that its others speak of most."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import FUNCTION_WORDS, bounded, is_function_word, row_keys, tokens
from ..sources import written

#: A word ties sentences of its source if at least two and at most MOST of them hold it; a briefing sets no bound.
MOST = math.inf
ROUNDS = 8
DAMPING = 0.85
#: Sentences of a source that are weighed against one another first; where they don't give enough that differ, all others follow.
POOL = 20
#: Sentences that meet in one block, about; larger sources are spread over several, small ones share one.
BLOCK = 400_000
#: Ties of a row of a block that sends nothing, about.
ROW = 1_000_000
PARTS = 1 << 16
#: A row with q = -1 has the ``keys`` and ``homes`` of a block's sentences, the others the ties to the words of a block q: ``ids`` are sentences by their number in the block, ``slots`` words by theirs in the row.
TIES = "q long, p long, alone boolean, keys binary, homes binary, words binary, terms binary, df binary, ids binary, slots binary"
COUNTED = "q long, p long, terms binary, df binary"
MASS = "q long, p long, mass binary"
SCORED = "k1 long, k2 long, home long, score double"


def content(sentence: Column, langs: Column) -> Column:
    """The different content words, by one of its languages: the least of those that have four words or more."""
    of = lambda k, lang: F.when(langs.bitwiseAND(F.lit(1 << k)) != 0, F.array_distinct(F.filter(tokens(sentence), lambda w: ~is_function_word(w, F.lit(lang)))))
    return F.array_min(F.filter(F.array(*[of(k, lang) for k, lang in enumerate(["", *FUNCTION_WORDS])]), lambda w: F.size(w) >= 4))


def stretches(docs: DataFrame) -> DataFrame:
    """source, sentence, langs (a bit a language): stretches of text up to ``.``, ``!``, ``?`` or a line's end, repeated ones too."""
    lang = F.coalesce(*[F.when(F.col("lang") == name, F.lit(1 << k)) for k, name in enumerate(FUNCTION_WORDS, 1)], F.lit(1)).cast("long")
    spread = docs.where("text IS NOT NULL").select("source", lang.alias("langs"), F.explode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("sentence"))
    return spread.select("source", F.trim(F.regexp_replace("sentence", r"\s+", " ")).alias("sentence"), "langs").where(F.length("sentence") >= 7)


def sentences(docs: DataFrame) -> DataFrame:
    """source, sentence, langs, of the different sentences of at least four different content words."""
    # a sentence that stands in several documents counts once, under the words of one of its languages; words are made once a sentence, and aren't sent
    return stretches(docs).groupBy("source", "sentence").agg(F.bit_or("langs").alias("langs")).where(content(F.col("sentence"), F.col("langs")).isNotNull())


class Layout(NamedTuple):
    """home, number, parts, low of each source, how many blocks those of few sentences share, and whether any has several parts."""

    sizes: DataFrame
    shared: int
    several: bool


def home() -> Column:
    """A source, or the lack of one, as text."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def layout(sizes: DataFrame, block: int = BLOCK) -> Layout:
    """Blocks for sources by ``sizes``: home, n (sentences, about)."""
    sizes = written(sizes.select("home", F.monotonically_increasing_id().alias("number"), F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long").alias("parts"), "n", (F.col("n") * 16 < block).alias("low")))
    n, parts = sizes.agg(F.coalesce(F.sum(F.when(F.col("low"), F.col("n"))), F.lit(0)), F.coalesce(F.max("parts"), F.lit(1))).head()
    if parts > PARTS:
        raise ValueError(f"a source has {parts} blocks of {block} sentences; {PARTS} can be told apart")
    return Layout(sizes.drop("n"), max(1, math.ceil(n / block)), parts > 1)


def _numbers(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(x, kind)


def _row(q: int, p: int, alone: bool, **x: np.ndarray) -> tuple:
    return (q, p, alone, *[x[c].tobytes() if c in x else b"" for c in ("keys", "homes", "words", "terms", "df", "ids", "slots")])


def _distinct(values: np.ndarray):
    """The different values, how often each is there, and the number of each one's value."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.append(True, ordered[1:] != ordered[:-1])
    number, start = np.empty(len(values), "i4"), np.flatnonzero(first)
    number[order] = np.cumsum(first, dtype="i4") - 1
    return ordered[start], np.diff(start, append=len(values)), number


def _split(of_word: np.ndarray, term: np.ndarray):
    """Groups of words: each group's number, its words, its ties, and the words' numbers in their group."""
    of_word = of_word.astype("u2")
    of_tie, order = of_word[term], np.argsort(of_word, kind="stable")
    tied, words, ties = np.argsort(of_tie, kind="stable").astype("i4"), np.bincount(of_word), np.bincount(of_tie)
    slot, w, t = np.empty(len(of_word), "i4"), 0, 0
    for g in np.flatnonzero(words).tolist():
        mine = order[w : (w := w + words[g])]
        slot[mine] = np.arange(len(mine))
        yield g, mine, tied[t : (t := t + ties[g])], slot


def _held(most: float, schema: pa.Schema):
    """A block's sentences and their words. Those of sources that lie in one block have all their ties here; others wait for the counts of their words."""

    def of(key, rows):
        p, parts, k1, k2 = key[0].as_py(), rows["parts"][0].as_py(), rows["k1"].to_numpy(), rows["k2"].to_numpy()
        # sentences of few words are dropped here, as Spark would make the words once more for a filter
        order = np.flatnonzero(rows["terms"].is_valid().to_numpy())
        if not len(order):
            return schema.empty_table()
        order = order[np.lexsort((k2[order], k1[order]))]
        terms = rows.select(["terms"]).take(pa.array(order))["terms"].combine_chunks()
        ids = np.repeat(np.arange(len(order), dtype="i4"), terms.value_lengths().to_numpy(zero_copy_only=False))
        words, df, term = _distinct(terms.flatten().to_numpy())
        del terms
        keys, homes = np.stack([k1[order], k2[order]], 1), rows["number"].to_numpy()[order]
        table = lambda *x, **y: pa.Table.from_pylist([dict(zip(schema.names, _row(*x, **y), strict=True))], schema)
        out = [table(-1, p, parts == 1, keys=keys, homes=homes)]
        if parts == 1:
            kept = (df >= 2) & (df <= most)
            number, held = np.cumsum(kept, dtype="i4") - 1, kept[term]
            ids, term, df = ids[held], number[term[held]], df[kept].astype("i8")
            if not len(df):
                return schema.empty_table()
            for g, mine, tied, slot in _split(np.arange(len(df)) * math.ceil(len(ids) / ROW) // len(df), term):
                out.append(table(g, p, True, df=df[mine], ids=ids[tied].astype("i8"), slots=slot[term[tied]]))
        else:
            for part, mine, tied, slot in _split(words % parts, term):
                out.append(table(p // PARTS * PARTS + part, p, False, words=words[mine], df=df[mine].astype("i4"), ids=ids[tied], slots=slot[term[tied]]))
        return pa.concat_tables(out)

    return of


def _counted(most: float):
    """What the words of a block are numbered there, or -1 if they tie none, and how many sentences hold each."""

    def of(key, rows):
        rows = rows.sort_values("p")
        words, n = [_numbers(x, "i8") for x in rows["words"]], np.concatenate([_numbers(x, "i4") for x in rows["df"]])
        every, at = np.unique(np.concatenate(words), return_inverse=True)
        df = np.bincount(at, n, len(every)).astype("i8")
        kept = (df >= 2) & (df <= most)
        number, df = np.where(kept, np.cumsum(kept) - 1, -1).astype("i4")[at], df[at]
        ends = np.cumsum([len(x) for x in words])
        return pd.DataFrame([(key[0], p, number[b - len(x) : b].tobytes(), df[b - len(x) : b].tobytes()) for p, x, b in zip(rows["p"], words, ends, strict=True)], columns=["q", "p", "terms", "df"])

    return of


def _tied(key, held, counted):
    """A block's ties to the words that tie."""
    answers, out = {q: (_numbers(t, "i4"), _numbers(d, "i8")) for q, t, d in counted[["q", "terms", "df"]].itertuples(index=False)}, []
    for q, ids, slots in held.loc[held["q"] >= 0, ["q", "ids", "slots"]].sort_values("q").itertuples(index=False):
        (number, df), ids, slots = answers[q], _numbers(ids, "i4"), _numbers(slots, "i4")
        kept = number >= 0
        there, slot = kept[slots], (np.cumsum(kept) - 1).astype("i4")
        if kept.any():
            out.append(_row(q, key[0], False, terms=number[kept], df=df[kept], ids=ids[there].astype("i8"), slots=slot[slots[there]]))
    if out:
        keys = held[held["q"] < 0].iloc[0]
        out.append((-1, key[0], False, keys["keys"], keys["homes"], b"", b"", b"", b"", b""))
    return pd.DataFrame(out, columns=held.columns)


def ties(found: DataFrame, most: float = 64, block: int = BLOCK, blocks: Layout | None = None) -> tuple[DataFrame, DataFrame]:
    """``found`` with an id (two hashes of source and sentence); and the ties of its different sentences to words that 2 to ``most`` of their source hold, by block of words q and of sentences p.

    A sentence is sent once, to its block. A source that one block can hold has its ties there. Of a larger one, blocks of sentences tell blocks of words how many of their
    sentences hold each word, so a word that all sentences hold is sent once a block.
    """
    found = found.withColumn("id", F.struct(*row_keys("source", "sentence")))
    sizes, shared, several = blocks or layout(found.groupBy(home().alias("home")).agg(F.count(F.lit(1)).alias("n")), block)
    dealt = found.withColumn("home", home()).join(bounded(sizes), "home")
    p = F.when(F.col("low"), -1 - F.pmod(F.xxhash64("number"), F.lit(shared))).otherwise(F.col("number") * PARTS + F.pmod("id.k1", "parts"))
    dealt = dealt.select(p.cast("long").alias("p"), "number", "parts", "source", "sentence", "langs").repartition("p").groupBy("p", "number", "parts", "source", "sentence").agg(F.bit_or("langs").alias("langs"))
    dealt = dealt.select("p", "number", "parts", *row_keys("source", "sentence"), F.transform(content(F.col("sentence"), F.col("langs")), lambda w: F.xxhash64("number", w)).alias("terms"))
    kinds = {"q": pa.int64(), "p": pa.int64(), "alone": pa.bool_()}
    held = dealt.groupBy("p").applyInArrow(_held(most, pa.schema([(x.split()[0], kinds.get(x.split()[0], pa.binary())) for x in TIES.split(", ")])), TIES)
    if not several:
        return found, held
    held = written(held)
    spread = held.where("NOT alone")
    counted = written(spread.where("q >= 0").select("q", "p", "words", "df").groupBy("q").applyInPandas(_counted(most), COUNTED))
    return found, held.where("alone").unionByName(spread.groupBy("p").cogroup(counted.groupBy("p")).applyInPandas(_tied, TIES))


def _block(placed: pa.Table):
    """A block's keys, homes, ties by row (q, ids, slots, weights, df) and the weight of each sentence's words; nothing is copied."""
    cells = lambda c, kind: [_numbers(x.as_buffer(), kind) for x in placed[c]]
    q = placed["q"].to_pylist()
    keys, homes = (cells(c, "i8")[q.index(-1)] for c in ("keys", "homes"))
    parts = sorted((x for x in zip(q, cells("ids", "i8"), cells("slots", "i4"), cells("df", "i8"), strict=True) if x[0] >= 0), key=lambda x: x[0])
    parts = [(q, at, slots, 1 / np.log(df + 1.0), df) for q, at, slots, df in parts]
    total = np.zeros(len(homes))
    for _, at, slots, weights, _ in parts:
        total += np.bincount(at, weights[slots], len(homes))
    return keys.reshape(-1, 2), homes, parts, total


def _given(score: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.divide(score, total, out=np.zeros(len(score)), where=total > 0)


def _scored(keys, homes, score, total) -> pa.Table:
    kept = total > 0
    return pa.table({"k1": keys[kept, 0], "k2": keys[kept, 1], "home": homes[kept], "score": score[kept]})


def _alone(rounds: int, damping: float):
    """All rounds of a block that sends nothing."""

    def of(key, placed):
        keys, homes, parts, total = _block(placed)
        score = np.ones(len(keys))
        for _ in range(rounds):
            given, score = _given(score, total), np.full(len(keys), 1 - damping)
            for _, at, slots, weights, df in parts:
                score += damping * np.bincount(at, (np.bincount(slots, given[at], len(df)) * weights / df)[slots], len(keys))
        return _scored(keys, homes, score, total)

    return of


def _of_sentences(damping: float, last: bool):
    """What a block of sentences gives the blocks of words, or its scores in the ``last`` round. Nothing came before the first."""

    def of(key, placed, came=None):
        keys, homes, parts, total = _block(placed)
        score = np.ones(len(keys))
        if came is not None:
            mass = dict(zip(came["q"].to_pylist(), (x.as_buffer() for x in came["mass"]), strict=True))
            score = sum(np.bincount(at, _numbers(mass[q], "f8")[slots], len(keys)) for q, at, slots, _, _ in parts) * damping + (1 - damping)
        if last:
            return _scored(keys, homes, score, total)
        given = _given(score, total)
        mass = [np.bincount(slots, given[at], len(weights)).tobytes() for _, at, slots, weights, _ in parts]
        return pa.table({"q": pa.array([x[0] for x in parts], pa.int64()), "p": pa.array([key[0].as_py()] * len(parts), pa.int64()), "mass": pa.array(mass, pa.binary())})

    return of


def _of_words(key, tied, came):
    """What a block of words gives back to the blocks of sentences: each word by weight, in equal parts to its sentences."""
    mass = dict(zip(came["p"], came["mass"], strict=True))
    parts = [(p, _numbers(t, "i4"), _numbers(d, "i8")) for p, t, d in tied[["p", "terms", "df"]].sort_values("p").itertuples(index=False)]
    n = 1 + max(int(t.max()) for _, t, _ in parts)
    at_words, rate = np.zeros(n), np.zeros(n)
    for p, terms, df in parts:
        at_words[terms] += _numbers(mass[p], "f8")
        rate[terms] = 1 / np.log(df + 1.0) / df
    at_words *= rate
    return pd.DataFrame([(key[0], p, at_words[terms].tobytes()) for p, terms, _ in parts], columns=["q", "p", "mass"])


def ranked(tied: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, several: bool = True) -> DataFrame:
    """id, home, score of a walk from sentence to word to sentence: the sentence graph's power iteration, without a row for a pair of sentences.

    A step from a sentence goes to one of its words by weight, and from the word to one of its sentences by the weight it has there; with 1 - damping it begins anew at any sentence.
    A source within one block takes all its steps there. Of others (``several``, if there may be any) blocks exchange one number for each word and block of sentences that holds it;
    the ties stay, as Spark reuses their exchange in every round.
    """
    scored = tied.where("alone").select("p", "q", "keys", "homes", "df", "ids", "slots").groupBy("p").applyInArrow(_alone(rounds, damping), SCORED)
    if several:
        spread = tied.where("NOT alone")
        placed = spread.select("p", "q", "keys", "homes", "df", "ids", "slots").groupBy("p")
        of_words = spread.where("q >= 0").select("q", "p", "terms", "df").groupBy("q")
        mass = placed.applyInArrow(lambda key, rows: _of_sentences(damping, False)(key, rows), MASS)
        for k in range(1, rounds + 1):
            back = of_words.cogroup(mass.groupBy("q")).applyInPandas(_of_words, MASS)
            mass = placed.cogroup(back.groupBy("p")).applyInArrow(_of_sentences(damping, k == rounds), SCORED if k == rounds else MASS)
        scored = scored.unionByName(mass)
    return written(scored.select(F.struct("k1", "k2").alias("id"), "home", "score"))


def _differs(x: Column, chosen: Column) -> Column:
    alike = lambda y: F.size(F.array_intersect(x["words"], y["words"])) * 2 >= F.least(F.size(x["words"]), F.size(y["words"]))
    return ~F.exists(chosen, alike)


def further(chosen: DataFrame, rest: DataFrame, k: int) -> DataFrame:
    """home, source, chosen, with the best of ``rest`` (home, x) that differs from all chosen, and again until there are k or none differs."""
    for _ in range(k - 1):
        found = rest.join(bounded(chosen.where(F.size("chosen") < k).select("home", "chosen")), "home").where(_differs(F.col("x"), F.col("chosen")))
        best = written(found.groupBy("home").agg(F.min_by("x", F.struct(-F.col("x.score"), F.col("x.sentence"))).alias("x")))
        if best.isEmpty():
            break
        chosen = written(chosen.join(bounded(best), "home", "left").select("home", "source", F.when(F.col("x").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array("x"))).alias("chosen")))
    return chosen


def briefing(docs: DataFrame, k: int = 3, pool: int = POOL) -> DataFrame:
    """source, rank, sentence, score: the k sentences of a source that a walk over its words comes by most, chosen to differ. Fidelity: partial (extracts; nothing is rewritten).

    Sentences of a source are tied by all words that at least two of them hold; a word weighs the less the more hold it. Each further one chosen is the best of all tied sentences of the
    source that share less than half of their words with any chosen before: of the ``pool`` best first, and of the others where these don't give k. Scores are rounded to six places; ties
    go by the sentence.

    Null texts have none; a null source is one source; equal sentences of a source are one; a source whose sentences share no word has no row.
    """
    # sources are laid out by the length of their texts, about a hundred a sentence
    blocks = layout(docs.where("text IS NOT NULL").groupBy(home().alias("home")).agg(F.ceil(F.sum(F.length("text")) / 100).alias("n")))
    found, tied = ties(stretches(docs), MOST, blocks=blocks)
    scores = ranked(tied, several=blocks.several).withColumn("score", F.round("score", 6))

    def told(wanted):
        """home, source, x (sentence, score, words) of wanted sentences, whose texts are read again."""
        texts = found.join(bounded(wanted.select("id", "home", "score")), "id").groupBy("home", "source", "sentence", "score").agg(F.bit_or("langs").alias("langs"))
        return texts.select("home", "source", F.struct("sentence", "score", content(F.col("sentence"), F.col("langs")).alias("words")).alias("x"))

    # by score alone first, all ties kept, so that sentences stay where they are
    ahead = scores.withColumn("place", F.rank().over(Window.partitionBy("home").orderBy(F.desc("score")))).where(F.col("place") <= pool)
    best = told(ahead).withColumn("place", F.row_number().over(Window.partitionBy("home").orderBy(F.desc("x.score"), "x.sentence"))).where(F.col("place") <= pool)
    groups = best.groupBy("home", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda y: y["x"]).alias("pool"))
    chosen = F.aggregate("pool", F.slice("pool", 1, 1), lambda acc, x: F.when((F.size(acc) < k) & _differs(x, acc), F.concat(acc, F.array(x))).otherwise(acc))
    groups = written(groups.select("home", "source", chosen.alias("chosen"), F.size("pool").alias("n")))
    open_ = groups.where(F.size("chosen") < k).join(scores.groupBy("home").agg(F.count(F.lit(1)).alias("every")), "home").where("every > n").select("home", "source", "chosen")
    open_ = written(open_)
    done = groups.select("home", "source", "chosen")
    if not open_.isEmpty():
        rest = written(told(scores.join(bounded(open_.select("home")), "home")).select("home", "x"))
        done = done.join(bounded(open_.select("home")), "home", "left_anti").unionByName(further(open_, rest, k))
    return done.select("source", F.posexplode("chosen").alias("at", "x")).select("source", (F.col("at") + 1).cast("long").alias("rank"), "x.sentence", "x.score")
