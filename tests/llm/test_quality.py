import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import quality, queries

FOLDER = "/root/testdata/sf0.01"


def auc(score, good):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = good.sum()
    return (rank[good].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(good) - n1))


def test_held_out_quality(spark):
    rows = {r.doc_id: r for r in queries.op13_quality(spark, FOLDER).collect()}
    assert len(rows) == 1000
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for d, r in rows.items())
    held = [(rows[d].score, q == 1) for d, q in labels if rows[d].held_out]
    score, good = (np.array(x) for x in zip(*held, strict=True))
    assert auc(score, good) > 0.97
    assert (score[good] >= 0.3).mean() > 0.97


def test_scores_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    n = len(quality.STATISTICS)
    m = quality.Machine(0.3, rng.normal(size=quality.PLACES), rng.normal(size=(quality.PLACES, quality.RANK)), np.zeros(n), np.ones(n), 1.3, -0.2)
    make = quality.Vectors()
    vectors = [make(t, s) for t, s in (("the river and the stone", 23), ("", None), ("A b! 12 #é\n\nA b!", 5))]
    for vector, got in zip(vectors, m.scores(vectors), strict=True):
        places, values, _ = m.rows([vector])
        raw = m.w0 + (m.w[places] * values).sum() + sum(m.v[a] @ m.v[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(places, values, strict=True), 2))
        assert got == pytest.approx(1 / (1 + np.exp(-(1.3 * raw - 0.2))))


def test_pairs_are_learned():
    """Whether two words stand together decides, neither alone does: only the interactions can tell."""
    rng = np.random.default_rng(2)
    make, texts, good = quality.Vectors(), [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        texts.append(f"{['river', 'stone'][a]} {['green', 'white'][b]}")
        good.append(float(a == b))
    m = quality.learn([make(t, len(t)) for t in texts], np.array(good), 40)
    scores = m.scores([make(t, len(t)) for t in texts])
    assert ((scores > 0.5) == np.array(good, dtype=bool)).mean() > 0.95


def test_calibration_is_of_least_loss():
    rng = np.random.default_rng(3)
    raw = rng.normal(size=4000)
    good = (rng.random(4000) < 1 / (1 + np.exp(-(2 * raw - 1)))).astype(float)
    scale, shift = quality.calibrated(raw, good)
    assert scale == pytest.approx(2, abs=0.25) and shift == pytest.approx(-1, abs=0.2)
    assert all(np.isfinite(quality.calibrated(np.array([-1.0, 1.0]), np.array([0.0, 1.0]))))


def test_quality_odd(spark):
    """Null, empty and very long texts, one huge word, repeated rows and labels, null identifiers and labels, clashing columns, a table without n_chars."""
    good, bad = "the river runs by the old stone mill.", "### $$$ ### %%% $$$ ###"
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}", 40) for i in range(120)]
    rows += [(200, None, None), (201, "", 0), (202, f"{good} " * 30_000, -5), (203, "x" * 2_000_000, 2), (None, good, 3), (1, f"{good} 1", 40), (1, f"{good} 1", 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit("x") for c in ("score", "id", "good", "stated", "places", "quality")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1, 1), (1, 1), (None, 0), (3, None), (777, 0)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    found = quality.score(docs, machine).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.score for r in found}
    assert min(by[i] for i in range(1, 120, 2)) > max(by[i] for i in range(0, 120, 2)) and by[202] > 0.5
    assert [r.score for r in found if r.doc_id == 1] == [by[1]] * 3
    again = quality.fit(docs.repartition(7), labels.repartition(5))
    assert np.array_equal(machine.v, again.v) and machine.scale == again.scale
    assert {r.score for r in quality.score(docs.drop("n_chars"), machine).where("doc_id < 120").collect()} != set()
    assert quality.score(docs.limit(0), machine).count() == 0
    only = quality.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs.limit(3), only).collect()} == {1.0}
    assert {r.score for r in quality.score(docs.limit(3), quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_sample_is_bounded(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    quality_learn = quality.learn
    try:
        quality.learn = lambda vectors, good, *a: seen.append(len(vectors)) or quality_learn(vectors, good, 1)
        quality.fit(docs, labels, sample=50)
    finally:
        quality.learn = quality_learn
    assert seen == [50]
