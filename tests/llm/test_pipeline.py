import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import packing
from tests.llm.test_operators import ODD, SCHEMA, sets

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stage(spark, docs, FOLDER)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 0:
            assert docs.count() >= 0.98 * before
        if k == 1:
            assert docs.count() == before and docs.where(F.col("n_chars") != F.length("text")).isEmpty()
    fill = collections.Counter()
    for r in docs.collect():
        fill[r.sequence_id] += r.length
    assert fill and max(fill.values()) <= 2048


@pytest.mark.parametrize("k", range(5))
def test_stage_takes_odd_rows(spark, k):
    extra = ("lang_pred", "score", "n_lines", "size", "source_size", "target", "copies", "kept")
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))) for c in extra})
    stage = corpus_pipeline.STAGES[k][1]
    found = stage(spark, odd, FOLDER)
    rows = found.collect()
    if k < 4:  # further columns of any name go with their rows
        assert found.columns == odd.columns and rows
        assert all(r[c] == f"{c}{r.doc_id or 0}" for r in rows for c in extra)
    if k == 1:
        assert {r.doc_id: r.text for r in rows if r.doc_id in (3, 4, 7)} == {d: t for d, t, *_ in ODD if d in (3, 4, 7)}
    if k == 2:
        assert sum(r.doc_id in (4, 5) for r in rows) == 1 and {3, 6, 7} < {r.doc_id for r in rows}
    assert stage(spark, odd.limit(0), FOLDER).count() == 0


def test_near_stage_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()} == {1, 3}


def without_lines(texts):
    """Texts by ascending identifier without the lines that a smaller one holds."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    owner, out = {}, {}
    for d in sorted(texts):
        for line in texts[d].split("\n"):
            owner.setdefault(key(line), d)
        out[d] = "\n".join(x for x in texts[d].split("\n") if len(key(x)) < 10 or owner[key(x)] == d)
    return out


def without_near_copies(texts):
    shingled, parent = {d: sets(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in texts:
        for b in texts:
            both = len(shingled[a] & shingled[b]) if a < b else 0
            if both and 100 * both >= 75 * (len(shingled[a]) + len(shingled[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: t for d, t in texts.items() if root(d) == d}


def copies(texts, source):
    """How often the mix takes each document."""
    size = {d: len([w for w in t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]) for d, t in texts.items()}
    total = collections.Counter()
    for d, n in size.items():
        total[source[d]] += n
    names = sorted(total)
    weight, free, target, left = {k: i % 3 + 1 for i, k in enumerate(names)}, set(names), {}, sum(total.values())
    while over := [k for k in free if 3 * total[k] < left / sum(weight[x] for x in free) * weight[k]]:
        for k in over:
            target[k] = 3 * total[k]
            free.discard(k)
        left = sum(total.values()) - sum(target.values())
    target |= {k: left / sum(weight[x] for x in free) * weight[k] for k in free}
    rate = {d: target[source[d]] / total[source[d]] if total[source[d]] else 0.0 for d in texts}
    coin = lambda d: int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:8], 16) / 2**32
    return {d: math.floor(r) + (coin(d) < r - math.floor(r)) for d, r in rate.items()}


def test_pipeline_against_brute_force(spark):
    """The whole pipeline's rows against plain code for all stages but language ID, whose documents are taken as they are."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    found = {r.doc_id: r.text or "" for r in corpus_pipeline.identify_language(spark, docs, FOLDER).collect()}
    texts = without_near_copies(without_lines(found))
    want = {d: n for d, n in copies(texts, source).items() if n}
    got = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r.doc_id][r.copy].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    assert {d: len(c) for d, c in got.items()} == want
    encode = packing.encoder(packing.tokenizer_files()[0], None)
    for d, every in got.items():
        ids = [*encode(texts[d]), 1]
        for pieces in every.values():
            assert [x for _, piece, _ in sorted(pieces) for x in piece] == ids
            assert {total for *_, total in pieces} == {len(ids)}
