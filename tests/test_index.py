import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basalt.operators import digest, index


@pytest.mark.parametrize("block", [4, 64])
def test_pruned_search_is_whole_and_reads_less(spark, tmp_path, block):
    """A kept index gives what weighing every document gives, over further queries too, from fewer postings."""
    rng = random.Random(block)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    draw = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(400)], k=n))
    docs = spark.createDataFrame([(i, draw(rng.randrange(1, 60))) for i in range(3000)] + [(1, None), (None, draw(9)), (2, "")], "doc_id long, text string").withColumn("row", F.lit("x"))
    index.build(docs, str(tmp_path / "index"), block=block)
    for seed in range(2):
        asked = spark.createDataFrame([(i, " ".join(rng.sample(vocabulary, 3))) for i in range(12)] + [(20, None), (21, "nowhere"), (None, vocabulary[7])], "item_id long, text string")
        ranked, read = index.search(spark, str(tmp_path / "index"), asked)
        rows = lambda df: sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in df.collect())
        assert rows(ranked) == rows(digest.search_ranked(asked, docs))
        assert 0 < read["read"] < (0.5 if block == 4 else 1.01) * read["postings"], (seed, read)


def test_blocks_end_with_batches(spark, tmp_path):
    """Postings of a word and block stand in one row though batches cut the blocks, and what holds for a word is in its heads; weights aren't stored with postings."""
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 9)))) for i in range(200)], "doc_id long, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10)
    try:
        index.build(docs, str(tmp_path / "index"))
    finally:
        spark.conf.set(name, before)
    postings, heads = [spark.read.parquet(str(tmp_path / "index" / x)).collect() for x in ("postings", "heads")]
    assert len({(r.word, r.block) for r in postings}) == len(postings) == len(heads) and all(len(r.rows) <= 10 for r in postings)
    assert sorted((r.word, x.doc_id, x.tf, x.length) for r in postings for x in r.rows) == sorted((w, d, t.split().count(w), len(t.split())) for d, t in docs.collect() for w in set(t.split()))
    assert len({(r.word, r.idf) for r in heads}) == 8 and sum(r.n for r in heads) == sum(len(r.rows) for r in postings)
    asked = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert index.search(spark, str(tmp_path / "index"), asked)[0].collect() == digest.search_ranked(asked, docs).collect()


def test_ranked_search_sends_only_the_best(spark):
    """No row for a document and query, or a document and word, is shuffled."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "common " + " ".join(rng.choices("abcdefgh", k=9))) for i in range(4000)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, "common " + rng.choice("bcdefgh")) for i in range(50)], "item_id long, text string")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: [x for x in (seq.apply(i) for seq in [store.stageList(none, False, False, quantiles, none)] for i in range(seq.size()))]
    before = max((x.stageId() for x in stages()), default=-1)
    assert digest.search_ranked(asked, docs).count() == 250
    sent = [x.shuffleWriteRecords() for x in stages() if x.stageId() > before]
    assert len(sent) > 3 and 250 <= sum(sent) < 4000, sent


@pytest.mark.parametrize("limit, cells", [(None, None), (200, 50)])
def test_ranked_search_in_parts_is_whole(spark, monkeypatch, limit, cells):
    """Queries that go to tasks in parts, and documents in small batches, give what plain code gives: copies, ties, nulls and repeated queries too."""
    rng = random.Random(5)
    words = [f"w{a}{b}" for a in "abcde" for b in "vwxyz"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(120)]
    docs = [(rng.choice([None, f"d{rng.randrange(300)}", f"Ä{i}"]), rng.choice([None, *texts[:40]] + texts)) for i in range(400)]
    asked = [(rng.choice([None, *range(12)]), " ".join(rng.choices([*words, "the", "nowhere"], k=4))) for _ in range(30)] + [(50, None), (51, "nowhere"), (52, "the")]
    if limit:
        monkeypatch.setattr(digest, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(digest, "CELLS", cells)
    counts = [Counter((text or "").split()) for _, text in docs]
    n, mean = len(docs), sum(sum(c.values()) for c in counts) / len(docs)
    df, wanted = Counter(w for c in counts for w in c), {}
    for item, text in asked:
        wanted.setdefault(item, Counter()).update(set((text or "").split()) - {"the"})
    expected = []
    for item, terms in wanted.items():
        scored = []
        for (doc, _), c in zip(docs, counts, strict=True):
            parts = [t * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, t in terms.items() if c[w]]
            if parts:
                scored.append((-round(sum(parts), 6), doc is not None, (doc or "").encode(), doc))
        expected += [(item, at + 1, x[3], -x[0]) for at, x in enumerate(sorted(scored, key=lambda x: x[:3])[:5])]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, 17 if limit else held)
    try:
        found = digest.search_ranked(spark.createDataFrame(asked, "item_id int, text string"), spark.createDataFrame(docs, "doc_id string, text string")).collect()
    finally:
        spark.conf.set(name, held)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
