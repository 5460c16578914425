"""Near-duplicates among documents against brute force; columns that clash with those that operators make inside."""

import dataclasses
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import line_dedup, passage_dedup, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("n", "d", "k", "row", "_n", "_d", "_k", "_p", "_i", "_text", "_row", "_gone", "_drop", "fp", "key", "places", "lost", "drop", "spans", "K1", "own", "smallest", "seed", "pos", "side", "h1", "place")


def _brute(texts, least=0.8):
    """Smallest number of each text's group by Jaccard similarity of five-word shingle sets (a shorter text is one shingle)."""
    sets, where = [], {}
    for i, t in enumerate(texts):
        w = t.encode().lower().split()
        s = {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        sets.append(s)
        for x in s:
            where.setdefault(x, []).append(i)
    label, both = list(range(len(texts))), {}
    for own in where.values():
        for n, i in enumerate(own):
            for j in own[n + 1 :]:
                both[i, j] = both.get((i, j), 0) + 1
    empty = [i for i, s in enumerate(sets) if not s]
    links = [p for p, n in both.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)] + [(empty[0], i) for i in empty[1:]]

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        label[b] = a
    return [find(i) for i in range(len(texts))], links


def test_near_duplicates_of_documents(spark):
    """All documents of a table: none goes that is similar to none, and nearly all that should go do."""
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' order by 1").fetchall()
    label, links = _brute([t for _, t in docs])
    want = {docs[i][0] for i in range(len(docs)) if label[i] == i}
    got = {r.doc_id for r in simhash.keep_one(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert links and want <= got and len(got - want) <= 0.03 * (len(docs) - len(want))


def _copies(n, least, most, seed):
    """Copies of a text of 200 words, each with some words changed on its own."""
    rng, base = random.Random(seed), [f"b{seed}w{i}" for i in range(200)]
    texts = []
    for k in range(n):
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(least, most)):
            copy[at] = f"c{seed}n{k}n{at}"
        texts.append(" ".join(copy))
    return texts


def test_rejected_links_do_not_multiply(spark, monkeypatch):
    """A group of near copies of which hardly two are similar enough: what is compared in the end grows with the texts, not with their pairs."""
    texts, rows, write = _copies(250, 3, 4, 3), {}, simhash.stored

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)).collect()}
    label, _ = _brute(texts)
    want = {i for i in range(len(texts)) if label[i] == i}
    assert len(want) > 120 and got == want
    assert sum(n for name, n in rows.items() if name in ("sets", "judged", "going", "similar", "agreed", "rest")) <= 4 * len(texts)


@pytest.mark.parametrize("tile", [7, 2048])
def test_families_of_many_tiles(spark, tile):
    """Families that one task takes and that pairs of tiles share: the groups are those of brute force."""
    texts = [t for seed in range(6) for t in _copies(30, 0, 9, seed)] + ["", "one two", "one two"]
    plan = dataclasses.replace(simhash.Plan.by_similarity(), tile=tile)
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA), plan).collect()}
    label, _ = _brute(texts)
    want = {i for i in range(len(texts)) if label[i] == i}
    assert 6 < len(want) < len(texts) - 60 and got == want


def test_keys_widen_with_the_table():
    """Unlike fingerprints that share a key are a bounded share of the rows, whatever their number."""
    plan = simhash.Plan.by_similarity()
    for n in (10_000, 40_000):
        keys = simhash.sampled_keys(np.random.default_rng(n).integers(0, 256, (n, 64), np.uint8), simhash.sampled_bits(plan, n))
        assert keys.shape[1] < 120 and len(np.unique(keys)) >= 0.7 * keys.size
    assert len(simhash.sampled_bits(plan, 14_000_000)[0]) >= 24


def test_mates_and_common_counts():
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 60, 400))
    key[:100] = 0
    low = rng.integers(0, 2, 400) * 0x7FFF
    keep = simhash.with_mates(np.sort(key), low.astype(np.uint64), 3)
    key = np.sort(key)
    for i in range(400):
        same = [j for j in range(400) if j != i and key[j] == key[i]]
        assert keep[i] == (len(same) >= simhash.FEW or any(low[j] == low[i] for j in same))
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 90))) for _ in range(25)]
    got = simhash.common_counts(np.concatenate(sets), np.array(list(map(len, sets))), 64)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(25) for j in range(25) if i != j)


def test_fingerprint_bits_of_long_texts():
    """Bits are those of a plain count, also for more shingles than a byte counts."""
    for n in (0, 1, 254, 255, 256, 511, 1300):
        h = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        want = np.concatenate([2 * np.unpackbits(simhash._mix(h, t).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) > n for t in range(8)])
        assert (np.unpackbits(simhash.fingerprints([h], 5, 512)[0]) == want).all()


@pytest.fixture(scope="module")
def clashing(spark):
    passage = " ".join(f"w{i}" for i in range(70))
    rows = [(1, f"a\nb\nc\n{passage}", "en", "s", 1), (2, f"a\nb\nc\nd {passage}", "en", "s", 1), (3, "x y z", "en", "s", 1), (4, "x y z", "en", "s", 1), (None, None, None, None, None), (None, "x y z", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(0))) for c in CLASH})


@pytest.mark.parametrize("run", [simhash.keep_one, line_dedup.dedup_lines, passage_dedup.dedup_passages])
def test_other_columns_stay(clashing, run):
    rows = run(clashing).collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id or 0}" for r in rows for c in CLASH)
    assert len(rows) == (3 if run is simhash.keep_one else 6)


def test_fingerprints_with_clashing_columns(clashing):
    assert sorted(r.component_id or 0 for r in simhash.near_duplicates(clashing).collect())[-3:] == [3, 3, 3]
