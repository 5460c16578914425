"""Nearest neighbours along curves: recall where windows are a small part of the table, exact scores, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import curves


def _frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<float>{extra}")


def _nearest(v, q, k=20):
    s = v @ v[q]
    order = np.lexsort((np.arange(len(v)), -s))
    return [j for j in order[: k + 1] if j != q][:k], s


def test_recall_on_clustered_vectors(spark, tmp_path):
    """50,000 vectors around 500 centres: recall 0.9 while a query can score a quarter of the table at most, and less in fact; nothing in the plan grows but the number of tasks."""
    rng = np.random.default_rng(1)
    n = 50_000
    v = (rng.standard_normal((500, 64))[rng.integers(0, 500, n)] + 0.5 * rng.standard_normal((n, 64))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(v)}), tmp_path / "v.parquet")
    got = {}
    for r in curves.search(spark.read.parquet(str(tmp_path / "v.parquet")), every=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d, hit = v.astype(np.float64), 0
    for q in range(0, n, 100):
        want, s = _nearest(d, q)
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(x - s[j]) < 1e-12 for _, j, x in mine)
        hit += len({j for _, j, _ in mine} & set(want))
    assert hit >= 0.9 * 500 * 20
    assert curves.CURVES * curves.PROBES * 2 * curves.WINDOW < 0.25 * n  # windows overlap: the rows scored are fewer


def test_windows_are_scored_as_the_method_says():
    """A query sees the union of its windows and nothing else."""
    rng = np.random.default_rng(3)
    data, ids = rng.standard_normal((400, 8)).astype(np.float32), rng.permutation(400).astype(np.int64)
    asks, at = np.array([7, 9, 7]), np.array([100, 3, 390])
    codes = data[[5, 6, 5]]
    for q, got, score in curves.window_lists(data, ids, codes, at, asks, 25, 10):
        rows = [*range(75, 125), *range(365, 400)] if q == 7 else range(28)
        c = codes[0] if q == 7 else codes[1]
        want = sorted(((-float(data[r] @ c), int(ids[r])) for r in rows))[:10]
        assert [j for _, j in want] == got.tolist() and np.allclose([-x for x, _ in want], score, atol=1e-5)


def test_hilbert_is_a_walk():
    """On a whole grid the keys are 0 to n - 1, and neighbours in order are neighbours in the grid."""
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack([x.ravel() for x in np.meshgrid(*[np.arange(1 << bits)] * axes)], axis=1)
        key = curves.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("scale", [False, True])
def test_small_tables_are_exact(spark, scale):
    """Fewer rows than a window: all are scored. A vector that many rows hold, ties, ids that repeat, vectors that take no part, clashing columns."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((300, 16)).astype(np.float32)
    v[100:160] = v[100]
    if scale:
        v *= rng.uniform(0.1, 5, (300, 1)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, v[20].tolist())] * 2
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("inf")] * 16), (2060, [None] * 16), (None, [1.0] * 16), (2080, [1.0] * 3), (2100, [])]
    df = _frame(spark, rows).withColumns({c: F.lit(1) for c in ("n", "q", "h1", "h2", "v", "ids", "key", "rank", "score", "id", "border")})
    got = {}
    for r in curves.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d = v.astype(np.float64)
    assert set(got) == set(range(0, 300, 20))
    for q, mine in got.items():
        want, s = _nearest(d, q)
        assert [j for _, j, _ in sorted(mine)] == want and np.allclose([x for *_, x in sorted(mine)], s[want], atol=1e-12, rtol=0)
    assert curves.search(df.limit(0)).count() == 0 and curves.search(df.filter("vec_id = 2000")).count() == 0


def test_few_rows_and_one_id_with_two_vectors(spark):
    got = sorted(map(tuple, curves.search(_frame(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (3, [0.5, 0.0])])).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 1, 1, 2.0), (0, 2, 3, 0.0), (0, 2, 3, 0.5)]


@pytest.mark.parametrize("n, probes", [(6000, 1), (2500, 32)])
def test_probes_are_added_until_the_recall_suffices(spark, n, probes):
    """The query's settings on vectors of independent components; with one probe to begin with, more are added. The recall is measured here against brute force of all queries."""
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(4)
    rows, told, used = curves.search_to(df, curves=8, probes=probes, spread=0.25, window=50)
    found = {}
    for r in rows.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x, hits = v.astype(float), []
    for i in range(0, n, 20):
        s = x @ x[i]
        s[i] = -9
        hits.append(len(found[i] & set(np.lexsort((np.arange(n), -s))[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9 and told >= 0.92 and abs(told - np.mean(hits)) < 0.05
    assert used > 1 if probes == 1 else used >= probes


def test_search_to_without_queries_or_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None)], "vec_id bigint, embedding array<float>")
    assert curves.search_to(df)[0].collect() == [] and curves.search_to(df.limit(0))[0].collect() == []


def _odd(kind, n=2000):
    rng = np.random.default_rng(5)
    g = rng.standard_normal((n, 24))
    u = g / np.linalg.norm(g, axis=1, keepdims=True)
    if kind == "one long":
        u[7] *= 1000
    elif kind == "lengths":
        u *= np.exp(2 * rng.standard_normal((n, 1)))
    elif kind == "near copies":
        u[: n // 2] = u[0] + 1e-4 * g[: n // 2]
    else:
        u *= 1e-30  # squares that floats don't hold
    return u.astype(np.float32)


@pytest.mark.parametrize("kind", ["one long", "lengths", "near copies", "short"])
def test_odd_vectors_find_their_nearest(spark, kind):
    """One vector that is much longer than the others, lengths of many orders, many near copies, very short vectors: nearly all of the nearest are found by the query's settings."""
    v = _odd(kind)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(4)
    found = {}
    for r in curves.search_to(df, curves=8, probes=32, spread=0.25)[0].collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    d = v.astype(np.float64)
    assert np.mean([len(found[q] & set(_nearest(d, q)[0])) / 20 for q in range(0, len(v), 20)]) >= 0.9


def test_ranges_do_not_change_the_result(spark):
    """Windows reach over the ends of ranges: many short ranges give the rows that one gives."""
    v = _odd("lengths", 3000)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(1)
    one, many = (sorted(map(tuple, curves.search(df, window=20, probes=3, range_rows=r).collect())) for r in (20_000, 100))
    assert one == many
