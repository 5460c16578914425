"""Tables with rows replaced and deleted by key, against a dictionary."""

import random
from pathlib import Path

from latticework.sources.keyed import KeyedTable

SCHEMA = "k bigint, name string, v bigint"


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


def _now(table):
    return {r.k: (r.name, r.v) for r in table.read().collect()}


def test_random_writes_are_those_of_a_dictionary(spark, tmp_path):
    rng, want = random.Random(4), {}
    for step in range(7):
        table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=4, most=2)  # opened again each time
        assert table.version == step and _now(table) == want
        rows = {rng.randrange(30) if rng.random() < 0.9 else None: (rng.choice(["a", None]), step) for _ in range(12)}
        gone = {rng.randrange(30) for _ in range(5)}
        table.write(spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA), spark.createDataFrame([(k,) for k in gone], "k bigint"))
        want = {k: v for k, v in (want | rows).items() if k not in gone}
        assert _now(table) == want and all(len(f) <= 2 for f in table.folders.values())
    assert table.read().count() == len(want)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=8, most=1)
    table.write(spark.createDataFrame([(i, "a", i) for i in range(40)], SCHEMA))
    before, folders = _files(tmp_path), {b: list(f) for b, f in table.folders.items()}
    table.write(spark.createDataFrame([(7, "b", 0)], SCHEMA))
    bucket = spark.createDataFrame([(7,)], "k bigint").select(table.bucket()).first()[0]
    assert {b for b in folders if folders[b] != table.folders[b]} == {bucket}
    assert before.items() <= _files(tmp_path).items()  # no file was changed, and new ones are of that bucket alone
    assert all(f"bucket_={bucket}/" in p for p in set(_files(tmp_path)) - set(before))
    near = table.read(spark.createDataFrame([(7,)], "k bigint"))
    assert {r.k for r in near.collect()} < set(range(40)) and all(f"bucket_={bucket}/" in p for p in near.inputFiles())


def test_a_broken_write_is_not_seen(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"])
    table.write(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    monkeypatch.setattr(KeyedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    try:
        table.write(spark.createDataFrame([(1, "b", 2), (2, "b", 2)], SCHEMA))
    except OSError:
        pass
    monkeypatch.undo()
    assert _now(KeyedTable(spark, str(tmp_path), SCHEMA, ["k"])) == {1: ("a", 1)}


def test_replaced_sets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=4)
    assert _now(table) == {}
    table.replace_set(spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", None)], SCHEMA))
    table.replace_set(spark.createDataFrame([(2, None, 2), (3, "c", 3), (4, "d", 4)], SCHEMA))
    assert _now(table) == {2: (None, 2), 3: ("c", 3), 4: ("d", 4)}
    last = table.folders
    changed = spark.read.parquet(f"{tmp_path}/data/{[f for f, _ in last[spark.createDataFrame([(4,)], 'k bigint').select(table.bucket()).first()[0]]][-1]}")
    assert sorted(r.k for r in changed.collect()) == [1, 3, 4]  # the equal row was not written again
    table.replace_set(spark.createDataFrame([], SCHEMA))
    assert _now(table) == {}
