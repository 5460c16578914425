"""Repeated byte windows of contexts against brute force, on texts that are hard for suffix sorting; rows with clashing columns."""

import random

import numpy as np
import pytest

from latticework.llm import suffix_dedup


def _covered(texts):
    count = {}
    for b in texts:
        for i in range(len(b) - 199):
            count[b[i : i + 200]] = count.get(b[i : i + 200], 0) + 1
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(gone)
    return out


def _hard_texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab c") for _ in range(rng.randint(150, 700))) for _ in range(8)]
    texts = []
    for _ in range(70):
        kind = rng.randrange(7)
        t = rng.choice(base)
        if kind == 0:
            t = t[rng.randrange(60) :] + rng.choice(base)
        elif kind == 1:
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice("xyz") + t[at:]
        elif kind == 2:
            t = "ab" * rng.randint(90, 140)
        elif kind == 3:
            t = "\0" * rng.randint(190, 420)
        elif kind == 4:
            at = rng.randrange(len(t))
            t = rng.choice(base)[:at] + "é" + t[at : at + 230] + rng.choice("pq")
        elif kind == 5:
            t = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 300)))
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contexts_of_anchors(seed):
    """Anchors, contexts and suffix sorting without a cluster: each byte that a repeated window covers, and no other."""
    texts = [t.encode() for t in _hard_texts(seed)]
    rows = {}
    for d, b in enumerate(texts):
        data = np.frombuffer(b, np.uint8)
        if len(b):
            for _, at, key, _ in zip(*(x.tolist() for x in suffix_dedup.anchors(data, np.array([0]), np.array([len(b)]))), strict=True):
                lo = max(0, at - (suffix_dedup.LENGTH - suffix_dedup.GRAM))
                rows.setdefault((key, b[lo : at + suffix_dedup.LENGTH], at - lo), []).append((d, at))
    contexts = [(key, c, a, len(where)) for (key, c, a), where in sorted(rows.items())]
    got = [np.zeros(len(b), bool) for b in texts]
    for (key, c, a, _), span in zip(contexts, suffix_dedup.repeated(contexts), strict=True):
        if span:
            for d, at in rows[key, c, a]:
                got[d][at + span[0] : at + span[1]] = True
    for d, want in enumerate(_covered(texts)):
        assert (got[d] == want).all(), d


@pytest.mark.parametrize("hot", [4096, 2])
def test_rows_with_clashing_columns(spark, monkeypatch, hot):
    """Null and repeated ids, null texts, columns named like those made inside; also with anchors that count as hot."""
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    texts = [*_hard_texts(4)[:40], None, ""]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    rows = [(d, t, i, "a", "b", "c", 1) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, at int, k1 string, K2 string, spans string, removed int")
    got = {r["at"]: r for r in suffix_dedup.mark_repeats(df).collect()}
    want = _covered([(t or "").encode() for t in texts])
    for i, r in got.items():
        mine = np.zeros(len(want[i]), bool)
        for x in r.removed:
            mine[x.s : x.e] = True
        assert (mine == want[i]).all() and (r.k1, r.K2, r["spans"]) == ("a", "b", "c")
    assert len(got) == len(texts)
