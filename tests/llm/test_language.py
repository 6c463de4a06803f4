import collections

import numpy as np
import pytest

from basalt.llm import lang_id

TEXTS = ["The river, the STONE!", "Größe ist nicht alles", "a", "  --  ", "", None, "x1y2z 3", "中文 字", "Ünïcödé " * 400, "the river the stone", "y" * 100_000]


def plain_grams(text):
    """Feature: count of all n-grams of one to three characters, one character at a time; None without a letter."""
    if not text or not any(c.isalpha() for c in text.lower()):
        return None
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    s = " " + " ".join(s.split()) + " "
    whole, found = 2**64 - 1, collections.Counter()
    salts = [int(x) for x in lang_id.SALTS]
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            h = (salts[3] + n) & whole
            for k in range(n):
                h = ((h ^ ord(s[i + k])) * salts[k]) & whole
                h ^= h >> 29
            found[(((h * salts[3]) & whole) >> 48) & (lang_id.DIM - 1)] += 1
    return found


def test_features_and_frequencies_against_plain_code(spark, monkeypatch):
    """What the regression learns from: shares of n-grams times inverse document frequencies of all rows."""
    rows = [(i, t, "xy"[i % 2]) for i, t in enumerate(TEXTS)] + [(50, TEXTS[0], "x"), (51, "unlabelled words", None)]
    given = []

    def learned(data, classes):
        given.extend(data)
        return np.ones((lang_id.DIM, classes)), np.zeros(classes)

    monkeypatch.setattr(lang_id, "ftrl", learned)
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams = [g for _, t, lang in rows if lang and (g := plain_grams(t)) is not None]
    df = collections.Counter(f for g in grams for f in g)
    idf = lambda f: np.log((1 + len(grams)) / (1 + df[f])) + 1
    assert model.langs == ["x", "y"]
    assert np.allclose(model.weights[:, 0], [lang_id.SCALE * idf(f) for f in range(lang_id.DIM)])
    want = [sorted((f, n / g.total() * idf(f) * lang_id.SCALE) for f, n in g.items()) for g in grams]
    for ids, values, _ in given:
        assert any(len(w) == len(ids) and [f for f, _ in w] == ids.tolist() and np.allclose([x for _, x in w], values, rtol=1e-5) for w in want)


@pytest.mark.parametrize("chunk", [8, 1 << 18])
def test_prediction_against_plain_softmax(spark, monkeypatch, chunk):
    monkeypatch.setattr(lang_id, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    model = lang_id.Model(["a", "b", "c"], rng.normal(0, 3, (lang_id.DIM, 3)).astype(np.float32), rng.normal(size=3), 0.7)
    langs, scores = model.predict(TEXTS)
    for t, lang, score in zip(TEXTS, langs, scores, strict=True):
        g = plain_grams(t)
        if g is None:
            assert (lang, score) == ("und", 0.0)
            continue
        logits = (sum(n * model.weights[f].astype(float) for f, n in g.items()) / g.total() + model.bias) / 0.7
        p = np.exp(logits - logits.max())
        assert lang == model.langs[int(p.argmax())] and score == pytest.approx((p / p.sum()).max(), rel=1e-4)


def test_a_model_too_large_to_broadcast_fails_and_says_so(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "MODEL_BYTES", 1 << 10)
    with pytest.raises(ValueError, match="MODEL_BYTES"):
        lang_id.identify(spark.createDataFrame([("a",)], "text string"), lang_id.Model(["a"], np.zeros((lang_id.DIM, 1), dtype=np.float32), np.zeros(1), 1.0))
