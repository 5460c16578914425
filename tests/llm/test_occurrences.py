"""First and previous occurrences of seeds by ranges, with seeds that fill several tasks."""

import random

import numpy as np
import pytest

from latticework.llm import passage_dedup as P


@pytest.mark.parametrize("parts", [1, 3, 7, 16])
def test_each_occurrence_meets_an_earlier_one(spark, parts):
    rng = random.Random(parts)
    rows = list({(rng.choice([1, 1, 1, 1, 2, 2, rng.randrange(3, 400)]), rng.randrange(40), rng.randrange(2), rng.randrange(60)) for _ in range(3000)})
    side = lambda r: (r[1] % 3) | (r[3] % 2) << 16
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, side(r)) for r in rows] * 2, "seed bigint, d bigint, k bigint, pos int, side int")  # repeated rows are one
        got = {both: {((r.d, r.k, r.pos), (r.d2, r.k2, r.pos2), r.near) for r in P._earlier(df, both)[0].collect()} for both in (True, False)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    places = {}
    for s, *place in sorted(rows):
        places.setdefault(s, []).append(tuple(place))
    several = [own for own in places.values() if len(own) > 1]
    first = {(p, own[0]) for own in several for p in own[1:]}
    assert {(a, b) for a, b, _ in got[False]} == first
    before = {(p, prev) for own in several for prev, p in zip(own, own[1:], strict=False)}
    assert {(a, b) for a, b, _ in got[True]} == first | before | {(own[0], own[0]) for own in several}
    flags = {(r[1:], side(r)) for r in rows}
    sides = dict(flags)
    assert all(near == ((sides[a] ^ sides[b]) & 0xFFFF == 0 or (sides[a] ^ sides[b]) >> 16 == 0) for a, b, near in got[True])


def test_removed_words_do_not_depend_on_partitions(spark):
    """Texts that share a passage with random edits: same result in 1, 3, 8 and 16 partitions."""
    rng = random.Random(6)
    passage = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = []
    for _ in range(90):
        own = [f"x{rng.randrange(9000)}" if rng.random() < 0.06 else w for w in passage]
        texts.append(" ".join([f"p{rng.randrange(9000)}" for _ in range(30)] + own + [f"q{rng.randrange(9000)}" for _ in range(20)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    parts, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (1, 3, 8, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, P.dedup_passages(docs).select("doc_id", "text", "n_removed").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r[2] for r in results[0]) > 1000 and all(r == results[0] for r in results[1:])


def test_seeds_of_texts_at_once():
    """Texts taken together keep the seeds, hashes and sides that each keeps alone, as a plain window by window choice does."""
    rng, one = np.random.default_rng(1), lambda t, *x: P.many_seeds([t], *x)
    texts = [rng.integers(0, 3 if n % 2 else 1 << 40, n).astype(np.uint64) for n in (0, 1, 4, 5, 6, 23, 24, 25, 60, 300, 0)]
    for seed, window in ((5, 20), (4, 6), (3, 1)):
        row, at, h, side = P.many_seeds(texts, seed, window)
        alone = [one(t, seed, window) for t in texts]
        assert np.array_equal(row, np.repeat(np.arange(len(texts)), [len(x[1]) for x in alone]))
        for i, got in ((1, at), (2, h), (3, side)):
            assert np.array_equal(got, np.concatenate([x[i] for x in alone]))
        for t, (_, places, _, _) in zip(texts, alone, strict=True):
            every = [int(one(t[i : i + seed], seed, window)[2][0]) for i in range(len(t) - seed + 1)]
            wide = min(window, len(every))
            assert places.tolist() == sorted({min(range(i, i + wide), key=lambda j: (every[j], j)) for i in range(len(every) - wide + 1)} if every else [])
