"""Language-model scoring by cross-entropy difference.

Two matched models, of a target and of a background, share one vocabulary: the 256 bytes and the end of a text. Both are
n-gram models of ``ORDER`` symbols with Witten-Bell smoothing down to the uniform distribution, so for each context each
model's probabilities sum to 1 over the vocabulary. The background is of the corpus, the target of those documents
labelled of good quality. A document's score is the mean over its symbols of the loss under the target less the loss
under the background; lower is closer to the target.

Documents are dealt to ``FOLDS`` folds by a hash of their text, and a document is scored by a target and a background that both leave out its
fold, so neither it nor a copy of it speaks for itself in either. A text that only its own counts would make likely is unlikely to both.

N-grams are counted in their own tasks, added up there, and summed by key in one shuffle; the counts grow with the corpus
and stay a distributed table, as do the losses, which are made from them by joins with their shorter n-grams. Nothing
of the models reaches the driver or is broadcast. To be scored, documents are dealt in chunks of about ``CHUNK_BYTES``;
a chunk asks for each of its n-grams once, and meets the answers in one task, so a frequent n-gram is one row a chunk.
Labels are broadcast if counted small and joined by a shuffle otherwise. Texts are read whole, in pieces of ``CHUNK`` symbols.

Defined cases: null and empty text has no symbol, losses 0 and score 0; a document labelled several times is good if
one label says so; labels without a document do nothing; with no target document the target is uniform; repeated
rows are counted and scored each; an empty table gives an empty result; only the identifier is carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

V = 257
#: Of 2 to 5, the one under which scores part good from bad best on half of the labels of sf0.1.
ORDER = 3
FOLDS = 4
CHUNK = 2 << 20
CHUNK_BYTES = 16 << 20
#: Different n-grams that a task adds up before it sends them on.
HELD = 1 << 20


def pieces(texts: list[bytes], order: int):
    """Lists of (text number, symbols) of about CHUNK symbols together: byte + 1, 0 for what precedes a text and for its end.

    A text longer than that comes in several pieces, each with the order - 1 symbols before it.
    """
    part, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        s = np.zeros(len(t) + order, dtype=np.int16)
        s[order - 1 : -1] = np.frombuffer(t, dtype=np.uint8)
        s[order - 1 : -1] += 1
        for at in range(0, len(t) + 1, CHUNK):
            p = s[at : at + CHUNK + order - 1]
            part.append((i, p))
            size += len(p)
            if size >= CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


def ngrams(part: list[tuple[int, np.ndarray]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol of the pieces as a number, and the text it is of."""
    s = np.concatenate([p for _, p in part])
    keys = np.zeros(len(s) - order + 1, dtype=np.int64)
    for k in range(order):
        keys *= V
        keys += s[k : len(s) - order + 1 + k]
    lengths = np.array([len(p) for _, p in part])
    keep = np.ones(len(keys), dtype=bool)
    for k in range(1, order):
        keep[np.cumsum(lengths)[:-1] - k] = False  # windows over two pieces
    return keys[keep], np.repeat([i for i, _ in part], lengths - order + 1)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids, where = np.unique(np.concatenate(keys), return_inverse=True)
    return ids, np.bincount(where, np.concatenate(counts), len(ids)).astype(np.int64)


def fold(text) -> F.Column:
    """Equal texts have equal folds."""
    return F.pmod(F.xxhash64(F.lit("fold"), text), F.lit(FOLDS)).cast("int")


def count_ngrams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """key, then counts in the documents, and in the target documents, of other folds than 0, 1..: n0.. and n4.., from rows of text, part: twice the fold, 1 more for a target document."""
    common.small_batches(rows.sparkSession)
    names = ["key", "part", "n"]

    def work(batches):
        keys, counts, held = [], [], 0

        def flush():
            codes, n = added(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(codes // (2 * FOLDS), pa.int64()), pa.array((codes % (2 * FOLDS)).astype(np.int32)), pa.array(n, pa.int64())], names=names)

        for b in batches:
            labels = b.column("part").to_numpy()
            for part in pieces([t.encode() for t in b.column("text").to_pylist()], order):
                grams, owner = ngrams(part, order)
                ids, n = np.unique(grams * (2 * FOLDS) + labels[owner], return_counts=True)
                keys.append(ids)
                counts.append(n)
                held += len(ids)
                if held > 2 * HELD:
                    ids, n = added(keys, counts)
                    keys[:], counts[:], held = [ids], [n], len(ids)
                    if held > HELD:
                        yield flush()
                        keys[:], counts[:], held = [], [], 0
        if held:
            yield flush()

    found = rows.select("text", "part").mapInArrow(work, "key long, part int, n long")
    elsewhere = lambda f: F.expr("part div 2") != f
    count = lambda when, j: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(f"n{j}")
    every = [count(elsewhere(f), f) for f in range(FOLDS)]
    return found.groupBy("key").agg(*every, *[count(elsewhere(f) & (F.col("part") % 2 == 1), FOLDS + f) for f in range(FOLDS)])


class Models:
    """The background without each fold (0, 1..) and the target without each (FOLDS and on) as the table ``counts`` of their n-grams."""

    def __init__(self, counts: DataFrame, order: int = ORDER):
        self.counts, self.order = counts, order

    def probabilities(self, keys: DataFrame | None = None) -> DataFrame:
        """key, p0, p1..: of the last symbol after those before it, for ``keys`` (of the corpus or not) or all n-grams counted."""
        numbers = range(2 * FOLDS)
        wanted = self.counts if keys is None else keys.select("key").distinct().join(self.counts, "key", "left").na.fill(0)
        lower = None
        for m in range(1, self.order + 1):
            end = lambda n: F.col("key") % F.lit(V**n)
            total = lambda df: df.groupBy(end(m).alias("key")).agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in numbers])  # noqa: B023, E731
            counted = self.counts if m == self.order else total(self.counts)
            context = counted.groupBy(F.expr(f"key div {V}").alias("ctx")).agg(*[F.sum(f"n{j}").alias(f"all{j}") for j in numbers], *[F.count_if(F.col(f"n{j}") > 0).alias(f"kinds{j}") for j in numbers])
            if m == self.order:
                here = wanted
            else:
                here = counted if keys is None else wanted.select(end(m).alias("key")).distinct().join(counted, "key", "left").na.fill(0)
            rows = here.withColumn("ctx", F.expr(f"key div {V}")).join(context, "ctx", "left")
            if lower is None:
                rows = rows.withColumns({f"p{j}": F.lit(1.0 / V) for j in numbers})
            else:
                rows = rows.withColumn("end", end(m - 1)).join(lower.withColumnRenamed("key", "end"), "end")
            mixed = lambda j: F.when(F.col(f"all{j}") > 0, (F.col(f"n{j}") + F.col(f"kinds{j}") * F.col(f"p{j}")) / (F.col(f"all{j}") + F.col(f"kinds{j}"))).otherwise(F.col(f"p{j}"))
            lower = rows.select("key", *[mixed(j).alias(f"p{j}") for j in numbers])
        return lower


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> Models:
    """Models of all ``docs`` and of those labelled 1."""
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).alias("id")).distinct().withColumn("good", F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), common.body(F.col(text_col)).alias("text"))
    rows = rows.join(common.checked_broadcast(good, good.count(), 40), "id", "left")
    rows = rows.select("text", (2 * fold("text") + F.when(F.col("good"), 1).otherwise(0)).alias("part"))
    return Models(common.cut(count_ngrams(rows, order)), order)


def score(docs: DataFrame, models: Models, counted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (bytes and the end), loss_target, loss_background (means a token) and score, their difference.

    ``counted`` says that the models have counted all of ``docs``, which saves a pass over them for n-grams that they lack.
    """
    order = models.order
    rows = docs.select(F.col(id_col).alias("doc_id"), common.body(F.col(text_col)).alias("text")).withColumn("fold", fold("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    # the partition is part of the hash, so that rows that repeat identifier and text are dealt to several chunks
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit("lm"), "doc_id", F.xxhash64("text"), F.spark_partition_id()), F.lit(1 + size // (FOLDS * CHUNK_BYTES))))
    by_chunk = dealt.groupBy("fold", "chunk")

    def ask(t: pa.Table) -> pa.Table:
        texts = [x.encode() for x in t.column("text").to_pylist()]
        keys = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(ngrams(p, order)[0]) for p in pieces(texts, order))]))
        same = lambda c, kind: pa.array(np.full(len(keys), t.column(c)[0].as_py()), kind)
        return pa.table({"fold": same("fold", pa.int32()), "chunk": same("chunk", pa.int64()), "key": pa.array(keys, pa.int64())})

    asked = by_chunk.applyInArrow(ask, "fold int, chunk long, key long")
    known = common.cut(models.probabilities(None if counted else asked))
    loss = lambda c: (-F.log(c)).cast("float")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), loss(F.col(f"p{FOLDS + f}")).alias("target"), loss(F.col(f"p{f}")).alias("background")) for f in range(FOLDS)]))
    answers = known.select("key", each.alias("x")).select("key", "x.*")
    answers = asked.join(answers, ["fold", "key"]).select("fold", "chunk", "key", "background", "target")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, background, target = (right.column(c).to_numpy() for c in ("key", "background", "target"))
        place = np.argsort(keys)
        keys, losses = keys[place], (target[place], background[place])
        texts = [x.encode() for x in left.column("text").to_pylist()]
        sums, n = np.zeros((2, len(texts))), np.array([len(x) + 1 if x else 0 for x in texts], dtype=np.int64)
        for part in pieces(texts, order):
            grams, owner = ngrams(part, order)
            at = np.searchsorted(keys, grams)
            for k in (0, 1):
                sums[k] += np.bincount(owner, losses[k][at], len(texts))
        mean = sums / np.maximum(n, 1)
        return pa.table({"doc_id": left.column("doc_id"), "n_tokens": pa.array(n), **{c: pa.array(x) for c, x in (("loss_target", mean[0]), ("loss_background", mean[1]), ("score", mean[0] - mean[1]))}})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return by_chunk.cogroup(answers.groupBy("fold", "chunk")).applyInArrow(work, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double")
