"""Quality of texts by a factorisation machine.

A text is a sparse vector: its words hashed to ``BUCKETS`` places, each 1 + log of its count and all together of length 1; statistics of its structure, and the
number of characters that the table states, each as a place of its own with its standardised value. The machine adds to
a linear score the interaction of each pair of places as the product of their ``RANK`` latent numbers. The sum over all pairs is half of
the square of the sum less the sum of the squares, so scoring takes time linear in the words. The score passes through a logistic function whose
scale and shift are fitted on a quarter of the sample that the machine doesn't learn from.

Learning takes a sample of at most ``SAMPLE`` labelled identifiers, those of smallest hash, whose vectors are made in the tasks; the machine is fitted on the driver, within that
bound, by AdaGrad in small batches. The model is BUCKETS * (RANK + 1) numbers whatever the corpus, and is broadcast. Texts are scored in the tasks that read them, without a shuffle.
No label, language, source or identifier is an input of a score.

Defined cases: null and empty texts have no word, and are scored by their statistics; texts and words of any length are taken whole; a missing or null number of characters is a place of its own; a row
labelled several times is good if one label says so, and null labels do nothing; without labelled rows of both kinds every score is the share of good
ones, 0.5 without any; rows that repeat an identifier are scored each; an empty table gives an empty result; only the identifier is carried along.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
RANK = 8
SAMPLE = 6000
EPOCHS = 12
BATCH = 64
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.3
#: Different words whose bucket a task remembers, and words scored at a time.
REMEMBERED = 1 << 18
WORDS = 1 << 19
WORD = re.compile(common.WORD_RE)
STATISTICS = [
    "characters", "words", "lines", "word length", "longest word", "words a line", "different words", "upper case", "digits", "marks", "other signs",
    "beyond ASCII", "white space", "commonest word", "lines that repeat", "words of one character", "empty", "stated characters", "nothing stated",
]
PLACES = BUCKETS + len(STATISTICS)
LETTERS, UPPERS, DIGITS, MARKS = re.compile(r"[A-Za-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[.,;:!?'\"()-]")
SIGNS, BEYOND, SPACES = re.compile(r"[#$%&*+/<=>@\[\\\]^_`{|}~]"), re.compile(r"[^\x00-\x7f]"), re.compile(r"\s")


def statistics(text: str, counts: Counter, stated: int | None) -> list[float]:
    """The structure of a text; shares and logarithms."""
    n, words, lines = len(text), counts.total(), text.split("\n")
    share = lambda found: sum(map(len, found)) / n if n else 0.0
    of = lambda pattern: share(pattern.findall(text))
    letters = sum(len(w) * c for w, c in counts.items())
    return [
        np.log1p(n), np.log1p(words), np.log1p(len(lines)), letters / words if words else 0.0, np.log1p(max(map(len, counts), default=0)), words / len(lines), len(counts) / words if words else 0.0,
        of(UPPERS), of(DIGITS), of(MARKS), of(SIGNS), of(BEYOND), of(SPACES), max(counts.values(), default=0) / words if words else 0.0, 1 - len(set(lines)) / len(lines),
        sum(c for w, c in counts.items() if len(w) == 1) / words if words else 0.0, float(not words), np.log1p(max(stated, 0)) if stated is not None else 0.0, float(stated is None),
    ]


class Vectors:
    """Makes vectors of texts; remembers words' buckets up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            found = zlib.crc32(word.lower().encode()) % BUCKETS
            if len(self.known) < REMEMBERED and len(word) < 64:
                self.known[word] = found
        return found

    def __call__(self, text: str, stated: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Places and values of the words, and the statistics."""
        counts = Counter(WORD.findall(text))
        merged: dict[int, int] = {}
        for w, c in counts.items():
            b = self.bucket(w)
            merged[b] = merged.get(b, 0) + c
        places = np.fromiter(merged.keys(), np.int32, len(merged))
        values = 1 + np.log(np.fromiter(merged.values(), np.float64, len(merged)))
        return places, (values / np.sqrt((values**2).sum())).astype(np.float32) if len(values) else values.astype(np.float32), statistics(text, counts, stated)


def sums(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the stretches of rows of ``x`` that begin at ``begins``; each row of a text holds its statistics, so none is empty."""
    return np.add.reduceat(x, begins, axis=0)


@dataclass
class Machine:
    """w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, then a logistic function of scale * it + shift."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    share: float | None = None  # the score of all, if nothing was learned

    def rows(self, vectors: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and values of several texts one after another, and where each begins."""
        own = np.arange(BUCKETS, PLACES)
        stats = np.clip((np.array([s for _, _, s in vectors]) - self.mean) / self.deviation, -4, 4) / np.sqrt(len(STATISTICS))
        places = np.concatenate([x for p, _, _ in vectors for x in (p, own)])
        values = np.concatenate([x for (_, x, _), s in zip(vectors, stats, strict=True) for x in (x, s)])
        begins = np.concatenate([[0], np.cumsum([len(p) + len(own) for p, _, _ in vectors])[:-1]])
        return places, values, begins

    def raw(self, places: np.ndarray, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        x = values[:, None]
        vx = self.v[places] * x
        pairs = 0.5 * (sums(vx, begins) ** 2 - sums(vx**2, begins)).sum(axis=1)
        return self.w0 + sums(self.w[places] * values, begins) + pairs

    def scores(self, vectors) -> np.ndarray:
        if self.share is not None:
            return np.full(len(vectors), self.share)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(*self.rows(vectors)) + self.shift, -40, 40)))


def learn(vectors: list, good: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Fit on three quarters of the rows by logistic loss, and scale and shift on the rest."""
    share = float(good.mean()) if len(good) else 0.5
    stats = np.array([s for _, _, s in vectors]).reshape(-1, len(STATISTICS))
    deviation = stats.std(axis=0) if len(stats) else np.ones(len(STATISTICS))
    rng = np.random.default_rng(0)
    m = Machine(0.0, np.zeros(PLACES), rng.normal(0, 0.05, (PLACES, RANK)), stats.mean(axis=0) if len(stats) else np.zeros(len(STATISTICS)), np.where(deviation > 1e-9, deviation, 1.0))
    if not vectors or not 0 < share < 1:
        m.share = share
        return m
    order = rng.permutation(len(vectors))
    held, used = order[: len(order) // 4], order[len(order) // 4 :]
    m.w0 = float(np.log(share / (1 - share)))
    g0, gw, gv = 1e-8, np.full(PLACES, 1e-8), np.full((PLACES, RANK), 1e-8)
    for _ in range(epochs):
        rng.shuffle(used)
        for k in range(0, len(used), BATCH):
            some = used[k : k + BATCH]
            places, values, begins = m.rows([vectors[i] for i in some])
            owner = np.repeat(np.arange(len(some)), np.diff(np.append(begins, len(places))))
            v = m.v[places]
            vx = v * values[:, None]
            total = sums(vx, begins)
            raw = m.w0 + sums(m.w[places] * values, begins) + 0.5 * (total**2 - sums(vx**2, begins)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - good[some]) / len(some)
            each = error[owner] * values
            ids, where = np.unique(places, return_inverse=True)
            by_v = each[:, None] * (total[owner] - vx)
            w_step = np.bincount(where, each, len(ids)) + DECAY * m.w[ids]
            v_step = np.stack([np.bincount(where, by_v[:, f], len(ids)) for f in range(RANK)], axis=1) + DECAY * m.v[ids]
            step = error.sum()
            g0 += step**2
            gw[ids] += w_step**2
            gv[ids] += v_step**2
            m.w0 -= RATE * step / np.sqrt(g0)
            m.w[ids] -= RATE * w_step / np.sqrt(gw[ids])
            m.v[ids] -= RATE * v_step / np.sqrt(gv[ids])
    if len(held) and 0 < good[held].mean() < 1:
        m.scale, m.shift = calibrated(m.raw(*m.rows([vectors[i] for i in held])), good[held])
    m.w, m.v = m.w.astype(np.float32), m.v.astype(np.float32)
    return m


def calibrated(raw: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Scale and shift of least logistic loss by Newton's method, to targets a little inside 0 and 1; the scale stays positive."""
    n1, n0 = good.sum(), len(good) - good.sum()
    want = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([raw, np.ones(len(raw))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - want) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def inputs(docs: DataFrame, id_col: str, text_col: str, stated_col: str) -> DataFrame:
    stated = F.col(stated_col).cast("long") if stated_col in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), common.body(F.col(text_col)).alias("text"), stated.alias("stated"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", stated_col: str = "n_chars", quality_col: str = "quality") -> Machine:
    """A machine of at most ``sample`` rows of ``docs`` that ``labels`` marks 1 (good) or 0."""
    common.small_batches(docs.sparkSession)
    marked = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(quality_col) == 1).cast("double")).alias("good"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = inputs(docs, id_col, text_col, stated_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "text", "stated", "good")
    names = ["id", "places", "values", "statistics", "good"]

    def work(batches):
        make = Vectors()
        for b in batches:
            every = [make(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("stated").to_pylist(), strict=True)]
            columns = [pa.array([p for p, _, _ in every], pa.list_(pa.int32())), pa.array([x for _, x, _ in every], pa.list_(pa.float32())), pa.array([list(map(float, s)) for _, _, s in every], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns, b.column("good")], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(work, f"id {kind}, places array<int>, values array<float>, statistics array<double>, good double")
    # of rows that repeat an identifier one is learned from; tasks add up their own before they meet
    found = found.groupBy("id").agg(F.min(F.struct("statistics", "places", "values", "good")).alias("x")).select("x.*").toArrow()
    arrays = lambda c: [x.values.to_numpy() for x in found[c]]
    vectors = list(zip(arrays("places"), arrays("values"), arrays("statistics"), strict=True))
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][2].tolist(), vectors[i][0].tolist()))  # whatever order the rows came in
    return learn([vectors[i] for i in order], found["good"].to_numpy()[order])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", stated_col: str = "n_chars") -> DataFrame:
    """doc_id and score, from 0 to 1 and higher the likelier good."""
    common.small_batches(docs.sparkSession)
    rows = inputs(docs, id_col, text_col, stated_col)
    model = docs.sparkSession.sparkContext.broadcast(machine)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches):
        make, m = Vectors(), model.value
        for b in batches:
            scores, held, size = [], [], 0
            for t, s in zip(b.column("text"), b.column("stated").to_pylist(), strict=True):
                held.append(make(t.as_py(), s))
                size += len(held[-1][0])
                if size > WORDS:
                    scores.append(m.scores(held))
                    held, size = [], 0
            if held:
                scores.append(m.scores(held))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(work, f"doc_id {kind}, score double")
