import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basalt.llm import periodic, queries

FOLDER = "/root/testdata/sf0.001"


def plain(s, least=24):
    """Runs by comparing each place with the one a period on."""
    n, found = len(s), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            w = s[i : i + size]
            if size >= max(least, 3 * q) and not any(all(w[k] == w[k + p] for k in range(size - p)) for p in range(1, q)):
                found.append((i, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [6, 12, 24, 25])
def test_runs_against_plain_search(least):
    rng = random.Random(least)
    for _ in range(400):
        kinds, s = rng.choice([1, 2, 3, 5, 50]), []
        while len(s) < rng.randrange(90):
            unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 12))]
            s += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)] if rng.random() < 0.5 else unit
        want = plain(s, least)
        assert periodic.runs(s, least) == want  # the refinement alone
        assert periodic.runs_of([[str(x) for x in s], [], [str(x) for x in s]], least) == [want, [], want]  # narrowed down before


def test_fibonacci_word_and_one_word():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    assert periodic.runs(list(b), 6) == plain(b, 6)
    assert periodic.runs_of([["x"] * 50_000]) == [[(0, 50_000, 1)]]


def digest(words):
    found = plain(words)
    lost = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in lost)))


def test_query_against_plain_search(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    tried = 0
    for doc_id, text in docs:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) < 2000:
            tried += 1
            assert got[doc_id] == digest(words), doc_id
    assert tried > 150 and sum(r[0] > 0 for r in got.values()) > 10


def test_runs_odd(spark, monkeypatch):
    """Null, empty and blank texts, one huge word, a very long text, repeated rows, null identifiers, clashing columns; several lots of texts."""
    monkeypatch.setattr(periodic, "WORDS", 40)
    unit = "the river runs by the old stone mill "
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, unit * 4), (4, unit * 4), (None, unit * 4), (5, "x" * 2_000_000), (6, unit * 20_000), (7, "a b " * 11 + "a b"), (8, "a b " * 12), (9, "stone " * 24 + "river " * 30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "collapsed", "start", "id")})
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(df).collect()), key=lambda r: r[0])
    short = unit.strip()
    assert got[0] == got[5] == got[4] == (got[0][0], [(0, 32, 8)], short) or got[0][1:] == got[4][1:] == ([(0, 32, 8)], short)
    by = {r[0]: r[1:] for r in got}
    assert by[1] == by[2] == by[3] == ([], "")
    assert by[5] == ([], "x" * 2_000_000)
    assert by[6] == ([(0, 160_000, 8)], short)
    assert by[7] == ([], ("a b " * 11 + "a b").strip()) if len(("a b " * 11 + "a b").split()) < 24 else by[7] == ([(0, 24, 2)], "a b")
    assert by[8] == ([(0, 24, 2)], "a b")
    assert by[9] == ([(0, 24, 1), (24, 30, 1)], "stone river")
    assert len(got) == len(texts)
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_best_run_compares_exactly(spark):
    runs = [(0, 3000000001, 1000000000), (1, 3000000002, 1000000000), (2, 3000000002, 1000000000), (3, 24, 8)]
    df = spark.createDataFrame([(runs,), ([],)], "runs array<struct<start: long, length: long, period: long>>")
    assert [r[0] and tuple(r[0]) for r in df.select(periodic.best_run(F.col("runs"))).collect()] == [runs[1], None]
