"""The kernel, the model and the sample of language identification against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import language_id as L


def _grams(text):
    """By definition: distinct runs of one to three characters, lower case, runs of other characters than letters as one space."""
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in t:
        t = t.replace("  ", " ")
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} if t.strip() else set()


TEXTS = ["Hello, world!", "été — ÇA va?", "aaaa", "a", " 12 b", "no 1 no", "日本 語", "ǅ ß Straße", "x" * 500]


def test_grams():
    for t in TEXTS:
        assert len(L.grams(t)) == len(_grams(t)), t
    for t in (None, "", " \n", "12 !"):
        assert not len(L.grams(t))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert L.grams("Ab, c").tolist() == sorted(code(g) for g in _grams("Ab, c"))


def test_kernel():
    rows = [(("en", "fr")[i % 2], L.grams(t)) for i, t in enumerate(TEXTS)]
    model = L._fit(rows, 3, 1e-2)
    chosen = [g for lang in ("en", "fr") for g in sorted((g for k, g in rows if k == lang), key=lambda g: -len(g))[:3]]
    k = model.kernel([g for _, g in rows])
    for i, (_, g) in enumerate(rows):
        for j, h in enumerate(chosen):
            assert k[i, j] == pytest.approx(len(set(g.tolist()) & set(h.tolist())) / np.sqrt(len(g) * len(h)), abs=1e-6)


def test_scores_are_those_of_ridge_regression():
    """With every text a landmark the Nystrom features give the kernel itself: the scores are those of weighted kernel ridge regression with a free constant."""
    rng = random.Random(2)
    rows = [(lang, L.grams(" ".join(rng.choice(words) for _ in range(12)))) for lang, words in (("en", ["the", "house", "of", "this"]), ("fr", ["le", "maison", "du", "cette"])) for _ in range(15)]
    model = L._fit(rows, 15, 1e-2)
    sets = [g for _, g in sorted(rows, key=lambda r: (r[0], -min(len(r[1]), 400)))]
    full = model.kernel(sets)
    value, vector = np.linalg.eigh(full + L.JITTER * np.eye(len(sets)))
    feature = np.hstack([model.kernel([g for _, g in rows]) @ vector @ np.diag(value**-0.5) @ vector.T, np.ones((len(rows), 1))])
    y = np.array([[1.0 if lang == k else -1.0 for k in ("en", "fr")] for lang, _ in rows])
    want = feature @ np.linalg.lstsq(np.vstack([feature, 0.1 * np.eye(feature.shape[1])]), np.vstack([y, np.zeros((feature.shape[1], 2))]), rcond=None)[0]
    assert np.allclose(model.scores([g for _, g in rows]), want, atol=1e-4)


def test_ties_go_to_the_first_by_name(spark):
    df = spark.createDataFrame([("b", "same text"), ("a", "same text")], "lang string, text string")
    assert {r.lang_pred for r in L.predict(df, L.fit(df)).collect()} == {"a"}


def test_sample_is_that_of_the_smallest_hashes(spark, monkeypatch):
    """A language with most rows, one with few texts, copies, nulls: the texts that the model is fitted on."""
    rows = [("en" if i % 50 else "fr", f"text number {i % 3000}") for i in range(9000)] + [("de", "eins"), ("de", "eins"), ("de", "1"), (None, "x"), ("es", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    seen = {}
    monkeypatch.setattr(L, "_fit", lambda got, *_: seen.update(rows=got))
    L.fit(df, sample=100)
    named = {}
    for r in df.filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text")).distinct().collect():
        named.setdefault(r.lang, []).append((r.h, r.text))
    want = [(lang, L.grams(t).tolist()) for lang in sorted(named) for _, t in sorted(named[lang])[:100] if len(L.grams(t))]
    assert [(k, g.tolist()) for k, g in seen["rows"]] == want
    with pytest.raises(ValueError, match="languages"):
        monkeypatch.setattr(L, "LANGUAGES", 1)
        L.fit(df)
