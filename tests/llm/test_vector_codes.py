"""Vector codes against k-means that scans everything, and the bounds against drifts added up."""

import random

import duckdb
import numpy as np
import pytest

from latticework.llm import vector_codes as codes

SCHEMA = "vec_id bigint, embedding array<double>, label string, entry int, Bounds string"


def brute(rows, parts, entries, rounds, scale):
    """rows: (vec_id, integers); codes, errors and codebooks by scanning all entries in Python's integers."""
    ids = sorted({i for i, _ in rows if i is not None})[:entries]
    first = [min(v for j, v in rows if j == i) for i in ids] or sorted(v for _, v in rows)[:entries]
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in rows:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for i, v in rows:
        at = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in at), sum(d for d, _ in at)))
    return out, books


@pytest.mark.parametrize("kind", ["plain", "ties", "large", "few"])
def test_codes_are_those_of_a_full_scan(spark, kind):
    rng = random.Random(kind)
    n, scale = (5 if kind == "few" else 300), (4 if kind == "ties" else 4096)
    value = {"plain": lambda: rng.gauss(0, 1), "ties": lambda: rng.randrange(-3, 4) / 4, "large": lambda: 2.0**22 + rng.gauss(0, 9), "few": lambda: rng.gauss(0, 1)}[kind]
    rows = [(i * 7 % 100 if kind == "ties" else 1000 - i, [value() for _ in range(8)], rng.choice(["a", "b", None])) for i in range(n)]
    rows += [rows[-1], rows[-1], (None, [value() for _ in range(8)], None)]
    odd = [(5, None, "a"), (6, [], "a"), (7, [float("nan")] * 8, "b"), (8, [None] + [0.0] * 7, "b"), (9, [float("inf")] * 8, None), (10, [1.0] * 4, "a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], SCHEMA).repartition(3)
    ints = [(i, [int(np.floor(scale * x)) for x in v]) for i, v, _ in rows]
    want, books = brute(ints, 4, 6, 4, scale)
    got, got_books = codes.compress(df, parts=4, entries=6, rounds=4, scale=scale)
    assert sorted(got.columns) == ["Bounds", "code", "entry", "error", "label", "vec_id"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.code.hex(), r.error) for r in got.collect()), key=key) == sorted(want, key=key)
    assert got_books.tolist() == books
    sums = {}
    for (_, _, label), (_, _, e) in zip(rows, want, strict=True):
        sums[label] = sums.get(label, 0) + e
    by_row = codes.coded(df, parts=4, entries=6, rounds=4, scale=scale).collect()
    assert sorted(r.label_error for r in by_row) == sorted(sums[label] for _, _, label in rows)


def test_bounds_settle_most_parts_and_are_no_looser_than_drifts():
    """Clustered parts: few full scans after the first rounds; the net displacement is at most the moves added up, and less where entries turn back."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (12, 8))
    x = centres[rng.integers(0, 12, 4000)] + rng.integers(-300, 300, (4000, 8))
    history = [x[None, :12].copy()]
    state = np.zeros(4000, codes.STATE)
    state["own_round"] = state["other_round"] = codes.NEVER
    scanned = []
    for _ in range(8):
        scanned.append(codes.assign(x, state, history, 0))
        d = ((x[:, None] - history[-1][0][None]) ** 2).sum(-1)
        assert (state["entry"] == d.argmin(1)).all()
        book = history[-1].copy()
        for e in range(12):
            if (state["entry"] == e).any():
                book[0, e] = x[state["entry"] == e].sum(0) // (state["entry"] == e).sum()
        history.append(book)
    assert scanned[0] == 4000 and scanned[-1] < 400
    h = np.stack(history)[:, 0].astype(float)
    net, drift = np.sqrt(((h[-1] - h[0]) ** 2).sum(-1)), np.sqrt((np.diff(h, axis=0) ** 2).sum(-1)).sum(0)
    assert (net <= drift + 1e-6).all() and (net < 0.95 * drift).any()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.coded(empty).collect() == []
    assert codes.coded(spark.createDataFrame([(1, None, "a", 1, "x")], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 9, "a", 1, "x")], SCHEMA))
    one = codes.coded(spark.createDataFrame([(None, [0.5] * 8, None, 1, "x")] * 3, SCHEMA)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(None, "00" * 8, 0, 0)] * 3


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = codes.query(spark, sf)
    want = c.execute(f"select {', '.join(got.columns)} from ({codes.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
