"""Anti joins behind filters of bits, and ranks over ranges."""

import random

from latticework.operators import exclusions, fold
from latticework.operators.stored_fold import SIGHTING


def test_few_rows_are_shuffled_and_none_is_lost(spark):
    rows = spark.range(20_000).selectExpr("concat('s', id % 7) as seed_id", "concat('r', id) as root", "id as word_")
    keys = spark.range(0, 20_000, 40).selectExpr("concat('s', id % 7) as seed_id", "concat('r', id) as root").union(spark.range(5000).selectExpr("'other'", "concat('q', id)"))
    clear, doubtful = exclusions.split(rows.drop("word_"), keys, ["seed_id", "root"])
    assert 500 <= doubtful.count() < 1500 and clear.count() + doubtful.count() == 20_000  # 500 equal a key; the rest is the filter's share
    got = {r.root for r in exclusions.without(rows.drop("word_"), keys, ["seed_id", "root"]).collect()}
    assert got == {f"r{i}" for i in range(20_000) if i % 40}


def test_five_exclusions(spark):
    make = lambda rows: spark.createDataFrame(rows, "seed_id string, root string")
    names = ["focus", "known", "yes", "no", "gone", "shared", "new", ""]
    got = exclusions.unexcluded(make([(s, n) for s in ("a", "b") for n in names] + [("a", None)]), make([("a", "focus")]), make([("a", "known")]), make([("b", "yes")]), make([("a", "no"), ("a", "no")]), spark.createDataFrame([("gone",)], "root string"), ["shared"])
    assert sorted(map(tuple, got.collect())) == [("a", "new"), ("a", "yes"), ("b", "focus"), ("b", "known"), ("b", "new"), ("b", "no")]
    none = make([])
    assert exclusions.unexcluded(none, none, none, none, none, none, []).count() == 0


def test_ranks_over_ranges(spark):
    """One key over many ranges: the ranks of a walk through it."""
    rng = random.Random(3)
    rows = [(i, f"o{i}", "e", *rng.choice([("ip", "10.0.0.1"), ("ip", "10.0.0.1"), ("domain", "a.org"), ("domain", f"h{i % 5}.org"), ("domain", None)]), "s", "discovery", rng.choice(["", "", "", "associated_infrastructure", "uncertain", "owned"]) if i > 40 else "", "", i) for i in range(200)]
    rank = {"": 0, "associated_infrastructure": 1, "uncertain": 2, "owned": 3}
    held, want = {}, {}
    for i, oid, _, kind, name, _, _, state, *_ in rows:
        first = (kind, name) not in held
        before = held.get((kind, name), 0)
        r = rank[state] or ((1 if kind == "ip" else 3) if first else 0)
        want[oid] = (first, r, before, r > before)
        held[(kind, name)] = max(before, r)
    got = fold.ranked_observations(spark.createDataFrame(rows, SIGHTING).repartition(3), range_rows=25)
    assert {r.id: (r.first, r["rank"], r.before, r.raised) for r in got.collect()} == want
