"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters over letters in lower case (all else is one blank), each
counted over the text's n-grams and multiplied by an inverse document frequency. Document frequencies and the number
of documents per language come from all rows to learn from, summed in their own tasks first. The weights are fitted on
the driver, on about ``PER_LANG`` rows a language chosen by hash (the documented bound), by follow-the-regularised-
leader with an elastic-net penalty; a fifth of them sets the temperature of the softmax.

Prediction reads the whole text; as the score is linear in the counts it is a sum over positions, so no per-document
table is built. The model is DIM x languages numbers at most, whatever the corpus.

Defined cases: null text and text without a letter are ``und`` with score 0; with no row to learn from all are
``und``; null languages are never learned; every other language is, whatever their number; repeated rows
count as often as they come; an empty table gives an empty result; other columns pass through and the added ones
replace columns of the same names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 1 << 16
#: Weights are broadcast up to this size, 256 KB a language; beyond it ``identify`` fails and says so.
MODEL_BYTES = 128 << 20
PER_LANG = 400
SCALE = 30.0
CHUNK = 1 << 18
CHUNK_LANGS = 256
ADDED = ["lang_pred", "score"]
SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def normal(text: str | None) -> np.ndarray | None:
    """Letters in lower case as code points, runs of all else as one blank, a blank at both ends; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    points = np.where(is_letter, points, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    points, keep = points[keep], None
    out = np.full(len(points) + 2, 32, dtype=np.uint64)
    out[1:-1] = points
    start = 1 if len(points) and points[0] == 32 else 0
    end = len(out) - (1 if points[-1] == 32 else 0)
    return out[start:end]


def hashed(points: np.ndarray, n: int) -> np.ndarray:
    """Feature numbers of the n-grams that start at each place."""
    count = len(points) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(count, SALTS[3] + np.uint64(n), dtype=np.uint64)
    for k in range(n):
        h = (h ^ points[k : k + count]) * SALTS[k]
        h ^= h >> np.uint64(29)
    return ((h * SALTS[3]) >> np.uint64(48)).astype(np.int64) & (DIM - 1)


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their share of the text's n-grams."""
    every = np.concatenate([hashed(points, n) for n in (1, 2, 3)])
    ids, n = np.unique(every, return_counts=True)
    return ids.astype(np.int32), (n / len(every)).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Texts are scored several at a time, in chunks of about CHUNK characters, fewer beyond CHUNK_LANGS languages."""
        chunk = CHUNK * CHUNK_LANGS // max(CHUNK_LANGS, len(self.langs))
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        part, size = [], 0
        for i, t in enumerate(texts):
            points = normal(t)
            if points is not None and self.langs:
                part.append((i, points))
                size += len(points)
            if part and (size >= chunk or i == len(texts) - 1):
                self._score(part, langs, scores)
                part, size = [], 0
        if part:
            self._score(part, langs, scores)
        return langs, scores

    def _score(self, part, langs, scores) -> None:
        points = np.concatenate([p for _, p in part])
        lengths = np.array([len(p) for _, p in part])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        owner = np.repeat(np.arange(len(part)), lengths)
        total = np.zeros((len(part), len(self.langs)))
        grams = np.zeros(len(part))
        for n in (1, 2, 3):
            h = hashed(points, n)
            gained = self.weights[h]
            if n > 1:
                gained[owner[: len(h)] != owner[n - 1 :]] = 0.0
            at = starts[starts < len(h)]
            total[: len(at)] += np.add.reduceat(gained, at, axis=0, dtype=np.float64)
            grams += np.maximum(lengths - n + 1, 0)
        logits = (total / grams[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for k, (i, _) in enumerate(part):
            langs[i], scores[i] = self.langs[best[k]], float(p[k, best[k]])


def ftrl(rows, classes: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
    """Weights and bias from rows of (features, values, class); the last feature is the bias."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    free = np.ones((1, classes))

    def weights(ids):
        zi, ni = z[ids], n[ids]
        penalty = np.where((ids == DIM)[:, None], 0.0, l1) * free
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            ids, values, label = rows[r]
            ids, values = np.append(ids, DIM), np.append(values, 1.0)
            w = weights(ids)
            logit = values @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1.0
            g = values[:, None] * p[None, :]
            before = n[ids]
            z[ids] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / alpha * w
            n[ids] = before + g * g
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def best_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Of 60 between 0.2 and 5, the one under which the true classes have the least loss."""

    def loss(t):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(truth)), truth]).mean())

    return float(min(np.exp(np.linspace(np.log(0.2), np.log(5.0), 60)), key=loss))


def fit(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``docs`` whose language is not null."""
    common.small_batches(docs.sparkSession, 250)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"))

    def frequencies(batches):
        df, langs = np.zeros(DIM, dtype=np.int64), {}
        for b in batches:
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                points = normal(t)
                if points is not None:
                    langs[lang] = langs.get(lang, 0) + 1
                    seen = np.zeros(DIM, dtype=bool)
                    for n in (1, 2, 3):
                        seen[hashed(points, n)] = True
                    df += seen
        ids = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * len(ids) + list(langs), pa.string()), pa.array(ids.tolist() + [None] * len(langs), pa.int32()), pa.array(df[ids].tolist() + list(langs.values()), pa.int64())], names=["lang", "feature", "n"]
        )

    # cut, as two results are read from it and texts are to be read once
    sums = common.cut(rows.select("text", "lang").mapInArrow(frequencies, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    counts, df = {}, np.zeros(DIM)
    for r in sums.where("lang is null").collect():  # DIM rows at most
        df[r["feature"]] = r["n"]
    for r in sums.where("lang is not null").orderBy(F.desc("n"), "lang").collect():
        counts[r["lang"]] = r["n"]
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((DIM, 0), dtype=np.float32), np.zeros(0), 1.0)
    idf = np.log((1.0 + sum(counts.values())) / (1.0 + df)) + 1.0

    rates = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_lang / n))) for k, n in counts.items()])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < rates * 1_000_000).select("text", "lang", "id")

    def sample(batches):
        for b in batches:
            found = [(lang, i, *map(np.ndarray.tobytes, counted(p))) for t, lang, i in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), b.column("id").to_pylist(), strict=True) if (p := normal(t)) is not None]
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["lang", "id", "ids", "tf"])

    got = sorted(chosen.mapInArrow(sample, "lang string, id string, ids binary, tf binary").collect(), key=lambda r: (r["lang"], r["id"] or "", r["ids"]))
    number, data = {k: i for i, k in enumerate(langs)}, []
    for r in got:
        ids = np.frombuffer(r["ids"], dtype=np.int32)
        data.append((ids, np.frombuffer(r["tf"], dtype=np.float32) * idf[ids] * SCALE, number[r["lang"]]))
    held = data[::5]
    learn = [d for i, d in enumerate(data) if i % 5] or data
    weights, bias = ftrl(learn, len(langs))
    temperature = best_temperature(np.array([v @ weights[i] + bias for i, v, _ in held]), np.array([y for *_, y in held]))
    return Model(langs, (weights * idf[:, None] * SCALE).astype(np.float32), bias, temperature)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone."""
    spark = docs.sparkSession
    common.small_batches(spark, 250)
    own = [c for c in docs.columns if c not in ADDED]
    if model.weights.nbytes > MODEL_BYTES:
        raise ValueError(f"the weights of {len(model.langs)} languages take {model.weights.nbytes >> 20} MB, more than the {MODEL_BYTES >> 20} MB that are broadcast; learn fewer languages or raise MODEL_BYTES")
    given = spark.sparkContext.broadcast(model)
    rows = common.with_columns_of(docs, own)
    at = own.index(text_col)

    def work(batches):
        for b in batches:
            langs, scores = given.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*own, *ADDED])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(work, f"{kinds}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the identifier as text, mod 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
