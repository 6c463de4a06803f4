import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from basalt.operators import briefing

SCHEMA = "doc_id long, source string, lang string, text string"


def plain(docs, k=3):
    """Sentences, a dense matrix of the walk between them, its power iteration, and the choice."""
    by = collections.defaultdict(dict)
    for _, source, lang, text in docs:
        for s in re.split(r"(?<=[.!?])\s+|\n", text or ""):
            s = re.sub(r"\s+", " ", s).strip()
            words = list(dict.fromkeys(w for w in re.findall(r"[^\W\d_]+", s.lower()) if not (lang == "en" and w in ("the", "of", "and", "a", "in"))))
            if len(words) >= 4:
                by[source][s] = words
    out = {}
    for source, found in by.items():
        names = sorted(found)
        df = collections.Counter(w for s in names for w in found[s])
        terms = sorted(w for w, n in df.items() if 2 <= n <= briefing.MOST)
        a = np.array([[1 / math.log(df[t] + 1) if t in found[s] else 0.0 for t in terms] for s in names])
        tied = a.sum(axis=1) > 0
        if not tied.any():
            continue
        names, a = [s for s, x in zip(names, tied, strict=True) if x], a[tied]
        step = (a / a.sum(axis=1, keepdims=True)) @ (a / a.sum(axis=0)).T  # sentence to word to sentence
        x = np.ones(len(names))
        for _ in range(briefing.ROUNDS):
            x = (x @ step) * briefing.DAMPING + 1 - briefing.DAMPING
        pool = sorted(zip((-x).round(6), names, strict=True))[: briefing.POOL]
        chosen = []
        for score, s in pool:
            if len(chosen) < k and all(2 * len(set(found[s]) & set(found[c])) < min(len(found[s]), len(found[c])) for c, _ in chosen):
                chosen.append((s, -score))
        out[source] = chosen
    return out


def test_against_a_dense_iteration(spark, monkeypatch):
    """Several sources, a null one, repeated sentences and rows, words too common to tie, nulls, a long text, clashing columns."""
    rng = random.Random(2)
    vocabulary = [f"{a}{b}{c}" for a in "kstbdm" for b in "aeiou" for c in "klmnr"]
    docs = []
    for d in range(60):
        text = " ".join(f"The {' '.join(rng.choices(vocabulary, k=rng.randrange(2, 12)))} always." for _ in range(rng.randrange(1, 9)))
        docs.append((d, rng.choice(["s", "t", None]), "en", text))
    docs += [docs[0], (90, "s", "en", None), (91, "u", "en", "alone here stands this one sentence."), (92, "v", None, "one two three four. one two three five!\none two six seven? short."), (93, "s", "en", "x" * 100_000), (None, None, None, None)]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "term", "score", "words", "rank", "sentence", "place")})
    got = collections.defaultdict(list)
    for r in sorted(briefing.briefing(df).collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(got[r.source]) + 1
        got[r.source].append((r.sentence, r.score))
    want = plain(docs)
    assert set(got) == set(want) and "u" not in got
    for source in want:
        assert len({x for _, x in got[source]}) > 1 or source == "v"
        assert [s for s, _ in got[source]] == [s for s, _ in want[source]] and np.allclose([x for _, x in got[source]], [x for _, x in want[source]], atol=2e-6)
    assert briefing.briefing(df.limit(0)).count() == 0


def test_a_word_makes_few_ties(spark):
    """A word of more than MOST sentences ties none, so rows grow with the words and never with pairs of sentences."""
    docs = [(i, "s", "en", f"common word every sentence{chr(97 + i % 26)}{chr(97 + i // 26)}.") for i in range(100)]
    found, tied = briefing.ties(briefing.sentences(spark.createDataFrame(docs, SCHEMA)))
    assert found.count() == 100 and tied.count() == 0


def test_blocks_send_less_than_ties(spark):
    """Sentences over many small blocks score as in one, and a block is sent one number for a word, however many of its sentences hold it."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "kstb" for b in "aeiou" for c in "klmnr"]
    docs = [(d, f"s{d % 3}" if d % 3 else None, "en", " ".join(rng.choices(vocabulary, k=9)) + f" {chr(97 + d % 26)}{chr(97 + d // 26)}.") for d in range(300)]
    found = briefing.sentences(spark.createDataFrame(docs, SCHEMA))
    scores = []
    for block in (1000, 20):
        kept, tied = briefing.ties(found, block=block)
        scores.append({r.sentence: r.score for r in kept.join(briefing.ranked(tied), "id").collect()})
        rows = tied.collect()
        n_ties, n_sent = sum(len(r.ids) for r in rows) // 8, sum(len(r.terms) for r in rows) // 4
        assert n_ties > 1000 and len(rows) > (block == 20) and n_sent < n_ties / (1.2 if block == 20 else 5), (n_ties, n_sent)
    assert scores[0].keys() == scores[1].keys() and np.allclose([scores[0][k] for k in scores[0]], [scores[1][k] for k in scores[0]], atol=1e-9)


def test_common_words_tie_too(spark, monkeypatch):
    """Words of more than 64 sentences, and of all, tie them: a source of such words alone has its briefing, as plain code gives it without a bound."""
    monkeypatch.setattr(briefing, "MOST", math.inf)
    monkeypatch.setattr(briefing, "POOL", 10**9)  # of the plain code
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "kstbdmpr" for b in ("ana", "eno", "ilo")]
    docs = [(d, "common", "en", f"river {' '.join(sorted(rng.sample(vocabulary, k=9)))} always.") for d in range(300)]
    got = [(r.sentence, r.score) for r in sorted(briefing.briefing(spark.createDataFrame(docs, SCHEMA)).collect(), key=lambda r: r["rank"])]
    want = plain(docs)["common"]
    assert [s for s, _ in got] == [s for s, _ in want] and len(got) > 1 and np.allclose([x for _, x in got], [x for _, x in want], atol=2e-6)


def test_choice_goes_on_beyond_the_pool(spark, monkeypatch):
    """Where the best sentences of a source are alike, the others that differ are found however far behind they are; other sources aren't touched."""
    monkeypatch.setattr(briefing, "POOL", 10**9)  # of the plain code
    alike = [f"river stone bridge castle market garden {chr(97 + d % 26)}{chr(97 + d // 26)}x." for d in range(60)]
    behind = [f"river {a}{b}k {a}{b}l {a}{b}m." for a in "klmn" for b in "aeio"]
    docs = [(d, None, "en", s) for d, s in enumerate(alike + behind)] + [(1000 + d, "t", "en", s) for d, s in enumerate(alike[:25])]
    docs += [(2000 + d, "u", "en", " ".join(random.Random(d).choices(["kana", "seno", "tilo", "bana", "deno", "milo", "pana", "reno"], k=7)) + ".") for d in range(40)]
    got = collections.defaultdict(list)
    for r in sorted(briefing.briefing(spark.createDataFrame(docs, SCHEMA)).collect(), key=lambda r: r["rank"]):
        got[r.source].append((r.sentence, r.score))
    want = plain(docs)
    assert got.keys() == want.keys() and len(want[None]) == 3 and len(want["t"]) == 1
    assert all(s in behind for s, _ in want[None][1:])
    for source in want:
        assert [s for s, _ in got[source]] == [s for s, _ in want[source]] and np.allclose([x for _, x in got[source]], [x for _, x in want[source]], atol=2e-6)


def test_a_word_of_all_sentences_is_sent_once_a_block(spark):
    """Without a bound, sentences over many blocks, in blocks of their own and in shared ones score as in one, and a word that all hold is one number a block."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in "kstb" for b in "aeiou" for c in "klmnr"]
    docs = [(d, "large" if d < 400 else f"small{d % 9}", "en", f"river {' '.join(rng.choices(vocabulary, k=9))}.") for d in range(500)]
    found = briefing.sentences(spark.createDataFrame(docs, SCHEMA))
    scores = []
    for block in (10_000, 50):
        kept, tied = briefing.ties(found, most=math.inf, block=block)
        scores.append({r.sentence: r.score for r in kept.join(briefing.ranked(tied), "id").collect()})
        rows = tied.collect()
        assert {r.alone for r in rows} == ({True} if block == 10_000 else {True, False})
        assert len({r.p for r in rows if not r.alone}) == (0 if block == 10_000 else 8)
        sent = collections.Counter(n for r in rows if not r.alone and r.q >= 0 for n in np.frombuffer(r.df, "i8"))
        assert sent[400] == (0 if block == 10_000 else 8)
    assert len(scores[0]) == 500 and scores[0].keys() == scores[1].keys() and np.allclose([scores[0][k] for k in scores[0]], [scores[1][k] for k in scores[0]], atol=1e-9)
