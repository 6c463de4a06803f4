"""Words of writing without blanks, found from the corpus itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bounded
from ..sources import written

#: A run of more letters is taken as stretches of so many.
STRETCH = 256
LONGEST = 4
#: What a word takes: occurrences, logarithm of how much more often it stands than its parts would by chance, and entropy of what stands beside it.
LEAST = 4
COHESION = 2.5
#: Few letters make more of what stands together chance, so an alphabet's words take less.
COHESION_OF_LETTERS = 1.5
FREEDOM = 0.7
HAN, LETTERS = r"\p{IsHan}", r"\p{L}"
BEGIN, END = "^", "$"


def stretches(text: Column, script: str = LETTERS) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{script}{{1,{STRETCH}}}"), F.lit(0))


def stretch_counts(docs: DataFrame, script: str = LETTERS) -> DataFrame:
    """run, n: the different stretches of letters of a script, in lower case. All that follows works on these, not on the texts."""
    return docs.select(F.explode(stretches(F.lower("text"), script)).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _pieces(text: Column, longest: int) -> Column:
    """Stretches of 1 to ``longest`` characters at each place, null beyond the end; place by place."""
    # cut from the text, as joining its characters anew for each stretch takes several times as long
    of = lambda x: F.flatten(F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.array(*[F.when(i + (k - 1) <= x["n"], F.substr(x["text"], i, F.lit(k))) for k in range(1, longest + 1)])))
    return F.get(F.transform(F.array(F.struct(text.alias("text"), F.length(text).alias("n"))), of), 0)


def _entropy(grams: DataFrame, word: Column, name: str) -> DataFrame:
    """word and the entropy of the character beside it."""
    n = F.col("n").cast("double")
    spread = grams.where("k > 1").select(word.alias("word"), "n").where(~F.col("word").contains(BEGIN) & ~F.col("word").contains(END))
    return spread.groupBy("word").agg(F.round(F.ln(F.sum(n)) - F.sum(n * F.ln(n)) / F.sum(n), 6).alias(name))


def lexicon(runs: DataFrame, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, freedom: float = FREEDOM) -> DataFrame:
    """word, n, weight, cohesion, freedom of the words found in ``runs`` (run, n), and of each single character, whose cohesion is null.

    Characters beside the begin or the end of a run count as standing beside that. Cohesion is the logarithm of n * N / (n1 * n2) for the likeliest cut in
    two, N being all characters; freedom is the smaller of the entropies of what stands before and after; weight is the logarithm of n / N.
    """
    padded = F.concat(F.lit(BEGIN), "run", F.lit(END))
    grams = runs.select("n", F.explode(_pieces(padded, longest + 1)).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    grams = written(grams.withColumn("k", F.length("word")))
    right = _entropy(grams, F.expr("substring(word, 1, k - 1)"), "after")
    left = _entropy(grams, F.expr("substring(word, 2)"), "before")
    inner = grams.where(~F.col("word").contains(BEGIN) & ~F.col("word").contains(END) & (F.col("k") <= longest))
    total = inner.where("k = 1").agg(F.sum("n").cast("double")).head()[0] or 1.0
    several = inner.where((F.col("k") > 1) & (F.col("n") >= least))
    cuts = several.select("word", "n", F.explode(F.expr("transform(sequence(1, k - 1), s -> struct(substring(word, 1, s) AS a, substring(word, s + 1) AS b))")).alias("cut")).select("word", "n", "cut.*")
    part = lambda c: inner.select(F.col("word").alias(c), F.col("n").alias(f"n{c}"))
    cuts = cuts.join(part("a"), "a").join(part("b"), "b")
    tight = cuts.groupBy("word").agg(F.round(F.min(F.ln(F.col("n") * F.lit(total) / (F.col("na").cast("double") * F.col("nb")))), 6).alias("cohesion"))
    found = inner.join(tight, "word", "left").join(left, "word").join(right, "word").withColumn("freedom", F.least("before", "after"))
    found = found.where((F.col("k") == 1) | ((F.col("cohesion") >= cohesion) & (F.col("freedom") >= freedom)))
    return found.select("word", "n", F.round(F.ln(F.col("n") / F.lit(total)), 6).alias("weight"), "cohesion", "freedom")


def found_words(docs: DataFrame, script: str = LETTERS, cohesion: float = COHESION_OF_LETTERS) -> DataFrame:
    """word, n, cohesion, freedom of words of two to four letters within runs of letters, in lower case. Fidelity: partial (Chinese has no blanks; other scripts show their syllables).

    Null texts have none; runs of more than 256 letters are taken as stretches of that; documents that repeat count each time.
    """
    return lexicon(stretch_counts(docs, script), cohesion=cohesion).where("cohesion IS NOT NULL").select("word", "n", "cohesion", "freedom")


def best_path(weights: Column, n: Column, longest: int = LONGEST) -> Column:
    """Lengths of the words that begin at each place, of the best way from there to the end; then the places where those of the best way of all begin.

    ``weights``: of the words of 1 to ``longest`` letters at each place, place by place, null where there is none. A way's weight is the sum of its words'; of equal ones the longer first word is taken.
    """
    start = F.struct(F.array(F.lit(0.0)).alias("ahead"), F.array().cast("array<int>").alias("lengths"))

    def step(state, i):
        ways = [F.get(weights, i * longest + k - 1) + F.get(state["ahead"], F.lit(k - 1)) for k in range(1, longest + 1)]
        best = F.greatest(*ways)
        length = F.coalesce(*[F.when(w == best, F.lit(k)) for k, w in reversed(list(enumerate(ways, 1)))])
        return F.struct(F.slice(F.concat(F.array(best), state["ahead"]), 1, longest).alias("ahead"), F.concat(F.array(length), state["lengths"]).alias("lengths"))

    back = F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), start, step)["lengths"]

    def walk(lengths):
        begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at: int, length: int>>").alias("words"))
        on = lambda s, i: F.when(s["next"] == i, F.struct((i + F.get(lengths, i)).alias("next"), F.concat(s["words"], F.array(F.struct(i.alias("at"), F.get(lengths, i).alias("length")))).alias("words"))).otherwise(s)
        return F.aggregate(F.sequence(F.lit(0), n - 1), begin, on)["words"]

    return F.get(F.transform(F.array(back), walk), 0)


def segmented(runs: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """run, words: each of ``runs`` (run, different ones) as the likeliest series of ``words`` (word, weight).

    The lattice of a run is joined from the lexicon, broadcast if counted small, and one column expression finds the best path through it.
    """
    # dealt by run before they are spread, so that a run's cells meet again where they are unless the lexicon is shuffled too
    dealt = runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run")
    cells = dealt.select("run", F.posexplode(_pieces(F.col("run"), longest)).alias("p", "word"))
    lattice = cells.join(bounded(words.select("word", "weight")), "word", "left").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("p", "weight"))).alias("cells"))
    lattice = lattice.select("run", F.transform("cells", lambda c: c["weight"]).alias("weights"))
    path = best_path(F.col("weights"), (F.size("weights") / longest).cast("int"), longest)
    return lattice.select("run", path.alias("path")).select("run", F.transform("path", lambda w: F.substr(F.col("run"), w["at"] + 1, w["length"])).alias("words"))


def word_pieces(docs: DataFrame, script: str = LETTERS, cohesion: float = COHESION_OF_LETTERS) -> DataFrame:
    """run, n, pieces: each different run of letters, its count, and the words found in it, joined by a blank. Fidelity: partial (as ``found_words``).

    Cases as in ``found_words``.
    """
    runs = written(stretch_counts(docs, script))
    return runs.join(segmented(runs.select("run"), lexicon(runs, cohesion=cohesion)), "run").select("run", "n", F.array_join("words", " ").alias("pieces"))
