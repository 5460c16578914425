"""Batches under a budget against a plain walk, with groups over many ranges."""

import random

import numpy as np
import pytest

from latticework.operators import batches

SCHEMA = "grp string, item int, size int, batch_size int"


def walk(sizes, budget):
    out, used, batch = [], 0, 0
    for n in sizes:
        if n > budget:
            out.append(None)
            batch, used = batch + (used > 0), 0
            continue
        if used + n > budget:
            used, batch = 0, batch + 1
        used += n
        out.append(batch)
    return out


def test_ranges_compose_to_the_walk():
    rng = random.Random(2)
    for _ in range(400):
        budget = rng.choice([1, 3, 10, 40])
        sizes = [rng.choice([0, 1, 2, 5, 9, 41, 3, 0]) for _ in range(rng.randrange(1, 40))]
        entry, before, got = -1, 0, []
        for a in range(0, len(sizes), 7):
            part = np.array(sizes[a : a + 7])
            got += batches.numbers(part, budget, entry, before).tolist()
            (entry, n), = batches.crossing(part, budget, [entry])
            before += n
        assert [None if x < 0 else x for x in got] == walk(sizes, budget)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_over_many_ranges(spark, seed):
    rng = random.Random(seed)
    groups = {"big": 400, "zeros": 60, None: 50, **{f"g{i}": rng.randrange(1, 12) for i in range(12)}}
    rows = [(g, i, (0 if g == "zeros" else rng.choice([0, 1, 3, 7, 12, 31, None]))) for g, n in groups.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    got = {}
    for r in batches.budget_batches(df, ["grp"], "item", "size", 30, range_rows=20).collect():
        got.setdefault(r.grp, []).append((r.item, r.batch))
    want = {g: walk([s or 0 for _, _, s in sorted(x for x in rows if x[0] == g)], 30) for g in groups}
    assert {g: [b for _, b in sorted(x)] for g, x in got.items()} == want


def test_one_large_group_is_no_single_task(spark):
    """Ranges hold about the rows they are asked to, so a group's work is split; batches that span several ranges come out whole."""
    df = spark.range(6000).selectExpr("'a' as grp", "id as item", "case when id % 997 = 0 then 500 else 1 end as size")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = batches.budget_batches(df, ["grp"], "item", "size", 450, range_rows=200)
        parts = got.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.batch for r in got.orderBy("item").collect()] == walk([500 if i % 997 == 0 else 1 for i in range(6000)], 450)
    assert len(parts) > 2 and max(r[1] for r in parts) < 5000


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert batches.budget_batches(none, ["grp"], "item", "size", 5).collect() == []
    with pytest.raises(Exception, match="negative"):
        batches.budget_batches(spark.createDataFrame([("a", 1, -1, 1)], SCHEMA), ["grp"], "item", "size", 5).collect()
