import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.operators import check, quotes

CLAIMS, DOCS = "item_id long, text string", "doc_id long, source string, text string"


def words(text):
    return [w.lower() for w in re.findall(r"[^\W\d_]+", text or "")]


def full(claim, text):
    """Best place of a claim by alignment with the whole text: (errors, end, start), of fewest errors the first end and last start."""
    column = [(i, 0) for i in range(len(claim) + 1)]
    ends = [(column[-1][0], 0, 0)]
    for j, w in enumerate(text, 1):
        new = [(0, -j)]
        for i, c in enumerate(claim, 1):
            new.append(min((column[i - 1][0] + (c != w), column[i - 1][1]), (column[i][0] + 1, column[i][1]), (new[-1][0] + 1, new[-1][1])))
        column = new
        ends.append((column[-1][0], j, column[-1][1]))
    errors, end, start = min(ends)
    return errors, end, -start


def quoted(claims, docs):
    """(item, doc): errors, first word and number of words of all quotes, by full alignment."""
    found = {}
    for i, c in claims:
        for d, _, t in docs:
            if len(words(c)) >= 4:
                errors, end, start = full(words(c), words(t))
                if errors <= (len(words(c)) - 4) // 5:
                    found[i, d] = errors, start, end - start
    return found


def changed(rng, claim, vocabulary, times):
    claim = list(claim)
    for _ in range(times):
        k, how = rng.randrange(len(claim)), rng.randrange(3)
        claim[k : k + (how < 2)] = [] if how == 0 and len(claim) > 1 else [rng.choice(vocabulary)]
    return claim


@pytest.mark.parametrize(("kinds", "seed"), [(25, 3), (400, 4), (3, 5)])
def test_no_quote_is_lost(spark, kinds, seed):
    """Words changed, dropped and put in, over few and many different words: the same as aligning every claim with every text."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "kstbdmnr" for b in "aeiou" for c in "kstbdmnrlp"][:kinds]
    claims = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(2, 45)))) for i in range(30)]
    docs = []
    for d in range(150):
        own = changed(rng, rng.choice(claims)[1].split(), vocabulary, rng.randrange(9))
        around = [rng.choices(vocabulary, k=rng.randrange(30)) for _ in range(2)]
        docs.append((d, f"s{d % 3}", ", ".join(w.upper() if rng.random() < 0.2 else w for w in around[0] + own + around[1]) + "."))
    got = {(r.item_id, r.doc_id): r for r in quotes.near_quotes(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(docs, DOCS)).collect()}
    want = quoted(claims, docs)
    assert {k: (r.errors, r.first_word, r.n_quoted) for k, r in got.items()} == want
    assert len(want) > 40 and len({e for e, _, _ in want.values()}) > 3
    for (_, d), r in got.items():
        text = docs[d][2]
        assert words(text[r.first_char : r.end_char]) == words(text)[r.first_word : r.first_word + r.n_quoted]


def test_quotes_odd(spark):
    """Nulls, short claims, repeated rows, a long text, one huge word, letters beyond ASCII, clashing columns, empty tables."""
    said = "the river runs by the old stone mill and sings"
    claims = [(1, said), (1, said), (2, None), (3, ""), (4, "the river runs"), (None, "Größe ist nicht alles im Leben"), (6, "x" * 100_000)]
    docs = [(1, "s", f"É 𝔸 😀 he wrote: The river ran by the old, stone mill and sings!"), (1, "s", "É 𝔸 😀 he wrote: The river ran by the old, stone mill and sings!"), (None, None, said), (3, None, None), (4, "", ""), (5, "t", "GRÖSSE IST; größe ist nicht ALLES im leben"), (6, "t", "lorem ipsum dolor sit " * 20_000 + said), (7, "t", "y" * 1_000_000)]
    clash = lambda df: df.withColumns({c: F.lit("x") for c in ("n", "e", "k1", "ask", "h", "band", "claim", "words", "errors")})
    a, b = clash(spark.createDataFrame(claims, CLAIMS)), clash(spark.createDataFrame(docs, DOCS))
    got = sorted((str(r.item_id), str(r.doc_id), r.errors, r.first_word, r.n_quoted) for r in quotes.near_quotes(a, b).collect())
    assert got == sorted([("1", "1", 1, 4, 10)] * 4 + [("1", "None", 0, 0, 10)] * 2 + [("1", "6", 0, 80_000, 10)] * 2 + [("None", "5", 0, 2, 6)])
    first = quotes.near_quotes(a, b).where("doc_id = 1").head()
    assert docs[0][2][first.first_char : first.end_char] == "The river ran by the old, stone mill and sings"
    by = {(r.item_id, r.source): (r.n_docs, r.n_changed, r.fewest_errors) for r in quotes.said_nearly(a.where("item_id = 1").limit(1), b).collect()}
    assert by == {(1, "s"): (2, 2, 1), (1, None): (1, 0, 0), (1, "t"): (1, 0, 0)}
    assert quotes.near_quotes(a.limit(0), b).count() == quotes.near_quotes(a, b.limit(0)).count() == 0


def test_winnowing_keeps_one_of_each_window(spark):
    rng = random.Random(1)
    lists = [rng.choices(range(9), k=n) for n in range(12)]
    df = spark.createDataFrame([(x,) for x in lists], "g array<long>")
    for g, kept in zip(lists, (r[0] for r in df.select(quotes.winnowed(F.col("g"))).collect()), strict=True):
        want = {i + min(range(len(g[i : i + 2])), key=lambda k: g[i + k]) for i in range(max(1, len(g) - 1))} if g else set()
        assert [(x["at"], x["h"]) for x in kept] == [(i, g[i]) for i in sorted(want)]


def test_alignment_stays_in_its_band():
    claim, text = np.arange(10), np.array([7, 7, *range(5), 99, *range(5, 10), 7])
    assert quotes.align(claim, text, -2, 6) == (1, 13, 2)
    assert quotes.align(claim, text, 3, 3)[0] == 5  # one diagonal alone: the first half is out of reach


def test_documents_are_spread_once(spark):
    """The report's plan explodes the documents' tokens in one place, and broadcasts no side that isn't counted small."""
    claims = spark.createDataFrame([(1, "a b c d e f g h"), (2, "b c")], CLAIMS)
    docs = spark.createDataFrame([(1, "s", "x a b c d e f g h y b c")], DOCS)
    asked = check._asked(claims)
    plan = check._met(asked, docs, runs=True, shared=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") <= 3 and plan.count("LocalTableScan") + plan.count("Scan ExistingRDD[doc_id") <= 2
    few = {(r.item_id, r.support) for r in check.check_report(claims, docs).collect()}
    assert few == {(1, "verbatim"), (2, "verbatim")}


def test_short_claims_beyond_the_limit(spark, monkeypatch):
    """Claims without an inner word meet by their first characters when they are too many to broadcast."""
    import basalt.functions

    monkeypatch.setattr(basalt.functions, "BROADCAST_BYTES", 0)
    claims = [(i, c) for i, c in enumerate(["", "a", "é ", "river", "old stone", "nothing", None, "xy", "𝔸😀z"])]
    docs = [(1, "s", "the river of old stone, é there"), (2, "s", "xy"), (3, "t", "a"), (4, "t", ""), (5, "t", None), (5, "u", "𝔸😀z"), (2, "s", "xy")]
    got = sorted((r.item_id, r.doc_id, r.source) for r in check.containing(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(docs, DOCS)).collect())
    assert got == sorted((i, d, s) for i, c in claims for d, s, t in docs if c is not None and t is not None and c in t)
