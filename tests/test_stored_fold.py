"""Folds in parts, stored and streamed, against the fold of the whole."""

import random

import pytest

from latticework.operators import fold
from latticework.operators.stored_fold import SIGHTING, AssetStore
from latticework.streaming.live_fold import live_fold, states


def _sightings(n, seed):
    rng = random.Random(seed)
    pick = rng.choice
    return [(i, pick([f"o{i}", "same"]), pick(["e1", "e2", None]), pick(["ip", "domain"]), pick(["Host.org", " host.ORG ", "10.0.0.1", "x.net", f"n{i % 9}.com"]), pick(["crt.sh", "dns_collector, CRT.sh", "", "Ptr "]),
             pick(["discovery", "discovery", "enrichment"]), pick(["", "", "owned", "uncertain", "associated_infrastructure"]), pick(["", "", "Resolved from a", " given ", "Discovered via crt.sh"]), pick([rng.randrange(50), None, 7])) for i in range(n)]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_of_parts_merge_to_the_whole(spark, seed):
    """Any grouping and order of the parts."""
    rows, rng = _sightings(160, seed), random.Random(seed)
    df = spark.createDataFrame(rows, SIGHTING)
    rng.shuffle(rows)
    parts = [fold.fold_states(spark.createDataFrame(rows[a:b], SIGHTING)) for a, b in ((0, 40), (40, 41), (41, 110), (110, 160))]
    rng.shuffle(parts)
    left = fold.merge_states(parts[0].unionByName(parts[1]))
    right = fold.merge_states(parts[3].unionByName(parts[2]))
    merged = fold.merge_states(right.unionByName(left))
    assert _rows(fold.finished(fold.with_provenance(merged, fold.provenance(df)))) == _rows(fold.canonical_assets(df))


def test_batches_fold_into_stored_assets(spark, tmp_path):
    rows = _sightings(120, 5)
    random.Random(1).shuffle(rows)
    batches = [rows[:50], rows[50:51], [], rows[51:]]
    for i, b in enumerate(batches):
        store = AssetStore(spark, str(tmp_path))  # opened again for each batch
        store.add(spark.createDataFrame(b, SIGHTING), i)
    store = AssetStore(spark, str(tmp_path))
    store.add(spark.createDataFrame(batches[3], SIGHTING), 3)  # known already
    want = _rows(fold.canonical_assets(spark.createDataFrame(rows, SIGHTING)))
    assert _rows(store.assets()) == want
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([], SIGHTING), 9)


def test_a_batch_that_broke_off_counts_once(spark, tmp_path, monkeypatch):
    rows = _sightings(60, 6)
    store = AssetStore(spark, str(tmp_path))
    store.add(spark.createDataFrame(rows[:30], SIGHTING), 0)
    monkeypatch.setattr(store.seen, "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.add(spark.createDataFrame(rows[30:], SIGHTING), 1)
    again = AssetStore(spark, str(tmp_path))
    again.add(spark.createDataFrame(rows[30:], SIGHTING), 1)
    assert _rows(again.assets()) == _rows(fold.canonical_assets(spark.createDataFrame(rows, SIGHTING)))


def test_streamed_over_restarts(spark, tmp_path):
    """Sightings out of order over two runs of the stream: the fold of all; a run touches only its keys."""
    rows = _sightings(90, 7)
    random.Random(2).shuffle(rows)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part, stop in ((rows[:60], 60), (rows[60:], 90)):
        spark.createDataFrame(part, SIGHTING).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SIGHTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = _rows(live_fold(spark, stream, str(tmp_path / "live"), str(tmp_path / "progress")))
        assert got == _rows(fold.canonical_assets(spark.createDataFrame(rows[:stop], SIGHTING)))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == old
    assert states(spark, str(tmp_path / "live")).count() <= 90


def test_streamed_states_are_aggregates(spark, tmp_path):
    """The fold and its provenance are states of Spark's own streaming operators, one row a key and one a provenance: no sighting passes through Python."""
    rows = _sightings(90, 8)
    spark.createDataFrame(rows, SIGHTING).write.parquet(str(tmp_path / "in"))
    got = _rows(live_fold(spark, spark.readStream.schema(SIGHTING).parquet(str(tmp_path / "in")), str(tmp_path / "live"), str(tmp_path / "progress")))
    assert got == _rows(fold.canonical_assets(spark.createDataFrame(rows, SIGHTING)))
    kept = spark.read.format("state-metadata").load(str(tmp_path / "progress"))
    assert {r.operatorName for r in kept.collect()} == {"stateStoreSave", "dedupe"}
    assert states(spark, str(tmp_path / "live")).count() == len(got)
