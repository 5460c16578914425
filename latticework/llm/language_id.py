"""Language identification with string kernels (operator 1).

The kernel of two texts is the normalised blended-spectrum presence kernel: the number of distinct character
n-grams (n = 1 to 3, lower case, runs of other characters than letters as one space) that both hold, over the
root of the product of their numbers. Landmarks chosen from labelled texts give Nyström features; one-versus-rest
kernel ridge regression on these features gives a weight for each landmark and language, and a batch of texts is
scored by two matrix products.

The classifier is fitted on a bounded sample of labelled texts (``sample`` distinct ones per language, in the order of
a hash of the text), prediction covers each row and its whole text. A null text, or one without a letter, gives ``und`` and
score 0. With no labelled row at all every text gets ``und``. Of languages that score alike the first by name is taken. Repeated
rows get equal results, input columns named like the new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, small_batches

#: Distinct labelled texts per language that the classifier is fitted on, at most, and landmarks per language among them.
SAMPLE, LANDMARKS = 500, 48
#: Languages that a model can have.
LANGUAGES = 1000
#: Longest n-gram, ridge and jitter.
LONGEST, RIDGE, JITTER = 3, 1e-2, 1e-6

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """By code point: itself for a letter, else a space."""
    global _CLASS
    if _CLASS is None:
        _CLASS = np.full(0x110000, 32, np.uint32)
        letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()], np.uint32)
        _CLASS[letters] = letters
    return _CLASS


def grams(text: str | None) -> np.ndarray:
    """Sorted codes of the distinct n-grams of a text; empty if it has no letter."""
    if not text:
        return np.empty(0, np.uint64)
    c = _classes()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    blank = c == 32
    if blank.all():
        return np.empty(0, np.uint64)
    c = c[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint64)
    found, code = [], np.zeros(len(c), np.uint64)
    for n in range(LONGEST):  # 21 bits for a code point: three of them fit in 63 bits
        if len(c) <= n:
            break
        code = (code[: len(c) - n] << np.uint64(21)) | c[n:]
        found.append(np.unique(code))
    return np.unique(np.concatenate(found))


@dataclass
class Model:
    """Codes of the landmarks' n-grams, their presence by landmark, root sizes, weights by landmark and language."""

    labels: list[str]
    codes: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel rows of a batch of n-gram sets against the landmarks, as one matrix product."""
        size = np.array([max(1, len(g)) for g in texts], np.float64)
        if not len(self.codes):
            return np.zeros((len(texts), len(self.sizes)))
        every = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        at = np.searchsorted(self.codes, every)
        hit = self.codes[np.minimum(at, len(self.codes) - 1)] == every
        row = np.repeat(np.arange(len(texts)), [len(g) for g in texts])[hit]
        used, col = np.unique(at[hit], return_inverse=True)
        has = np.zeros((len(texts), len(used)), np.float32)
        has[row, col] = 1
        return (has @ self.presence[used]).astype(np.float64) / np.sqrt(size)[:, None] / self.sizes[None, :]

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        k = self.kernel(texts)
        return np.hstack([k, np.ones((len(k), 1))]) @ self.weights


def _fit(rows: list[tuple[str, np.ndarray]], landmarks: int, ridge: float) -> Model:
    labels = sorted({lang for lang, _ in rows})
    chosen: list[np.ndarray] = []
    for lang in labels:  # texts with many n-grams tell most; a stable sort keeps the sample's order
        own = sorted((g for l, g in rows if l == lang), key=lambda g: -min(len(g), 400))
        chosen += own[:landmarks]
    codes = np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.uint64)
    presence = np.zeros((len(codes), len(chosen)), np.float32)
    for j, g in enumerate(chosen):
        presence[np.searchsorted(codes, g), j] = 1
    model = Model(labels, codes, presence, np.sqrt([max(1, len(g)) for g in chosen]), np.zeros((len(chosen) + 1, len(labels))))
    if not chosen:
        return model
    value, vector = np.linalg.eigh(model.kernel(chosen) + JITTER * np.eye(len(chosen)))
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, JITTER))) @ vector.T
    sets = [g for _, g in rows]
    feature = np.vstack([model.kernel(sets[i : i + 64]) for i in range(0, len(sets), 64)]) @ whiten
    feature = np.hstack([feature, np.ones((len(feature), 1))])
    target = np.array([[1.0 if l == k else -1.0 for k in labels] for l, _ in rows])
    # every language weighs alike, whatever its share of the sample
    weight = np.array([1 / sum(l == k for k, _ in rows) for l, _ in rows])[:, None] * len(rows) / len(labels)
    solved = np.linalg.solve(feature.T @ (feature * weight) + ridge * np.eye(feature.shape[1]), feature.T @ (target * weight))
    model.weights = np.vstack([whiten @ solved[:-1], solved[-1:]])
    return model


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on at most ``sample`` distinct texts of each language; rows with null text or language take no part.

    The sample is settled on hashes alone, which are spread evenly: from a language's estimated number of distinct texts follows the share
    of the hashes' range that holds some more than ``sample`` of them, and only hashes in it are gathered (in sets of distinct ones that
    map tasks combine); should one turn out to hold fewer, its share is doubled. So a group has about twice ``sample`` hashes, however many
    rows the language has. Texts are read for the hashes up to the last of the sample only, repeated ones combined in the map
    tasks. What reaches the driver is bounded by ``sample`` and the number of languages, of which there can be ``LANGUAGES``.
    """
    small_batches(labelled.sparkSession)
    named = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    sizes = named.groupBy("lang").agg(F.approx_count_distinct("h").alias("d")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share, limits = {r.lang: min(1.0, 1.5 * sample / max(1, r.d)) for r in sizes}, {}
    while share:
        upto = F.broadcast(labelled.sparkSession.createDataFrame([(k, (v - 0.5) * 2.0**64) for k, v in share.items()], "lang string, upto double"))
        near = named.select("lang", "h").join(upto, "lang").filter(F.col("h").cast("double") <= F.col("upto")).groupBy("lang").agg(F.slice(F.sort_array(F.collect_set("h")), 1, sample).alias("h"))
        found = {r.lang: r.h for r in near.collect()}
        limits |= {k: h[-1] for k, h in found.items() if len(h) == sample or share[k] == 1.0}
        share = {k: min(1.0, 2 * v) for k, v in share.items() if k not in limits}
    most = F.broadcast(labelled.sparkSession.createDataFrame(list(limits.items()), "lang string, most bigint"))
    rows = named.join(most, "lang").filter("h <= most").groupBy("lang", "h").agg(F.min("text").alias("text"))

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"grams": pa.array([grams(t).astype(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))}

    got = add_columns(rows, make, "grams array<bigint>", drop=["text"]).collect()
    got.sort(key=lambda r: (r["lang"], r["h"], r["grams"]))
    return _fit([(r["lang"], np.array(r["grams"], np.uint64)) for r in got if r["grams"]], landmarks, ridge)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) for each row."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by landmarks times languages

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        m, texts = shared.value, b.column(b.schema.get_field_index(text)).to_pylist()
        lang, score = [], []
        for i in range(0, len(texts), 64):
            sets = [grams(t) for t in texts[i : i + 64]]
            if not m.labels:
                lang, score = lang + ["und"] * len(sets), score + [0.0] * len(sets)
                continue
            s = m.scores(sets)
            best = s.argmax(1)
            for g, k, v in zip(sets, best.tolist(), s[np.arange(len(s)), best].tolist(), strict=True):
                lang.append(m.labels[k] if len(g) else "und")
                score.append(min(1.0, max(0.0, (v + 1) / 2)) if len(g) else 0.0)
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    return add_columns(docs, make, "lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: learn from the rows that aren't held out, predict every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs.filter(part != 2))
    return predict(docs.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "text"), model).drop("text")
