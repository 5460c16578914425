"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from latticework.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, factor=5):
    """counts: word -> n; (word, form, root, n, n_near, form_n) by comparing all words."""
    forms, close = {}, {}
    for w, n in counts.items():
        close[w] = [v for v in counts if v != w and near(w, v)]
        best = min(close[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= factor * n:
            forms[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(close[w]), counts[forms[w]] if w in forms else None))
    return out


def vocabulary(seed):
    rng = random.Random(seed)
    letters = "abcéÿß×"
    out = {}
    for _ in range(30):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 10)))
        for _ in range(rng.randrange(1, 12)):
            out[w] = rng.choice([5, 6, 25, 30, 125, 700])
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            v = w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind < 2) :]
            w = v if len(v) > 5 else w
    out |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "x" * 300: 9, "x" * 301: 50, "x" * 150 + "y" + "x" * 149: 5}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_random_words(spark, seed):
    counts = vocabulary(seed)
    df = spark.createDataFrame(sorted(counts.items()), "word string, n bigint").repartition(3)
    assert {tuple(r) for r in spelling.group_variants(df).collect()} == brute(counts)


def test_filters_in_several_passes(spark, monkeypatch):
    """Filters larger than what may be broadcast at once are probed in passes: same pairs, each once."""
    counts = vocabulary(3)
    monkeypatch.setattr(spelling, "CHUNK", 1)
    df = spark.createDataFrame(sorted(counts.items()), "word string, n bigint")
    vocab = spelling.stored(df, "vocabulary")
    pairs = [tuple(sorted((r.word, r.near))) for r in spelling.near_pairs(vocab, filter_bytes=128).collect()]
    want = sorted((a, b) for a in counts for b in counts if a < b and near(a, b))
    assert sorted(pairs) == want


def test_hashes_of_edits_are_those_of_the_words():
    whole = lambda w: spelling.drawn(np.arange(len(w)), spelling.code_points(w)).sum()
    words = ["abcabc", "aabbéé", "cccccc"]
    row, place, sums = spelling.deletions(np.stack([spelling.code_points(w) for w in words]))
    left = [words[r][:i] + words[r][i + 1 :] for r, i in zip(row, place, strict=True)]
    assert [whole(w) for w in left] == sums.tolist()
    assert sorted(left) == sorted(x for w in words for x in {w[:i] + w[i + 1 :] for i in range(len(w))})


def test_filters_let_little_through():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)]
    blocks = -(-len(words) * spelling.BITS // 512)
    cells = np.zeros((blocks, spelling.CELLS), np.uint64)
    for w in words:
        h = spelling.drawn(np.arange(9), spelling.code_points(w)).sum(keepdims=True)
        block = spelling.block_of(h, blocks)
        for i in range(spelling.HASHES):
            cell, mask = spelling.bit_of(h, i)
            cells[block, cell] |= mask
    f = spelling.Filters(cells.tobytes(), 0, {9: 0}, {9: blocks})
    sums = np.array([spelling.drawn(np.arange(9), spelling.code_points(w)).sum() for w in words], np.uint64)
    assert len(f.probe(9, sums)) == len(words)
    other = np.array([spelling.drawn(np.arange(9), spelling.code_points("".join(rng.choice("klmnopqrst") for _ in range(9)))).sum() for _ in range(20_000)], np.uint64)
    assert len(f.probe(9, other)) < 0.03 * len(other)
    assert len(f.probe(8, other)) == 0


def test_query_counts_words_as_its_contract_says(spark, tmp_path):
    rng = random.Random(11)
    base = ["Straße", "ÉCOLES", "planets", "plamets", "PLANET", "garden×s", "naïveté", "ñandúes", "kurz", "abcdef"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", "", "s", "1x"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(None, "planets planets"), (3, None), (4, ""), (5, "planets"), (5, "planets"), (6, "a" * 5000 + " " + "a" * 5000), (7, "a" * 5000 + " " + " ".join(["a" * 5000] * 2))]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, n int, word string")
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = spelling.group_variants(spelling.words(docs, misspell=True)).collect()
    assert {tuple(r) for r in got} == brute(counts) and len(got) == len(counts)
    assert spelling.group_variants(spelling.words(docs.limit(0))).collect() == []


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = spelling.query(spark, sf)
    want = c.execute(f"select {', '.join(got.columns)} from ({spelling.ORACLE_SQL})").fetchall()
    assert set(map(tuple, got.collect())) == set(want) and want
