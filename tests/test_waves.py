"""Waves against a run in plain Python, resumed at every step, and what a wave shuffles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from latticework.operators.waves import Waves

EVIDENCE = "parent_key string, seed_key string, source string, kind string, confidence double, reasoned boolean"


def plain(seeds, evidence, again=(), decisions=None, manual=False, waves=3):
    """Seeds by (wave, how), one dictionary of candidates that grows wave by wave."""
    known, seen = {s: (0, "given") for s in seeds}, {}
    wave = 0

    def take(rows, how, weak=False):
        touched = {}
        for seed, source, kind, confidence, reasoned in rows:
            if seed not in known:
                touched.setdefault(seed, []).append((source, kind, confidence, reasoned))
        for seed, told in touched.items():
            all_told = seen.setdefault(seed, [])
            all_told.extend(told)
            signal = [(s, k, c) for s, k, c, _ in all_told if s and k]
            promoted = any(r for *_, r in all_told) or any(c >= 0.9 for _, _, c in signal) or len({(s, k) for s, k, _ in signal}) > 1
            verdict = None if manual else True
            if decisions is not None:
                verdict = decisions.get(seed, verdict)
            if promoted and not verdict:
                seen.pop(seed)
                if verdict is None:
                    held.add(seed)
            if promoted and verdict or weak and not promoted:
                known[seed] = (wave + 1, how)

    def of(front):
        return [e[1:] for e in evidence if e[0] in front]

    held: set = set()
    while wave < waves:
        front = [s for s, (w, _) in known.items() if w == wave]
        if not front:
            wave -= 1
            break
        take(of(front), "promoted")
        wave += 1
    while wave > 0 and not any(w == wave for w, _ in known.values()):
        wave -= 1
    if again:
        take(again, "reconsidered")
        wave += 1
        front = [s for s, (w, _) in known.items() if w == wave]
        if front:
            take(of(front), "registered", weak=True)
    return {(s, *x) for s, x in known.items()}


def _evidence(n, keys, seed):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}", f"k{rng.randrange(keys)}", rng.choice(["a", "b", ""]), rng.choice(["x", ""]), rng.choice([0.1, 0.5, 0.95]) if rng.random() < 0.1 else 0.2, rng.random() < 0.15) for _ in range(n)]


def _stepwise(spark, path, decisions=None, reconsidered=None, **how):
    """A new object for each step, which knows the tables by their files alone."""
    while True:
        run = Waves(spark, path, **how)
        if not run.step(decisions, reconsidered):
            return run
        run.close()


@pytest.mark.parametrize("n", [500, 1200])
def test_resumed_runs_are_the_plain_one(spark, tmp_path, n):
    evidence, seeds = _evidence(n, 250, 5), ["k1", "k2", "k3"]
    again = [(f"k{i}", "r", "d", 1.0, True) for i in range(5, 30)]
    df, sd = spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame([(s,) for s in [*seeds, "k1"]], "seed_key string")
    more = spark.createDataFrame(again, EVIDENCE.split(", ", 1)[1])
    want = plain(seeds, evidence, again)
    assert len({w for _, w, _ in want}) == 6 and {h for *_, h in want} == {"given", "promoted", "reconsidered", "registered"}
    whole = Waves(spark, str(tmp_path / "whole"), buckets=4).start(sd, df).run(None, lambda run: more)
    assert {tuple(r) for r in whole.known().collect()} == want
    Waves(spark, str(tmp_path / "steps"), buckets=4).start(sd, df).close()
    run = _stepwise(spark, str(tmp_path / "steps"), None, lambda run: more, buckets=4)
    assert run.phase == "done" and {tuple(r) for r in run.known().collect()} == want


def test_depth_is_bounded_and_one_extra_wave_registers(spark, tmp_path):
    """A chain of keys: three waves, then no more; a reconsidered key opens one wave, whose finds are registered and not asked."""
    evidence = [(f"k{i}", f"k{i + 1}", "s", "k", 0.99, False) for i in range(9)] + [("x", "y", "s", "k", 0.1, False), ("y", "z", "s", "k", 0.99, False)]
    run = Waves(spark, str(tmp_path), buckets=2).start(spark.createDataFrame([("k0",)], "seed_key string"), spark.createDataFrame(evidence, EVIDENCE))
    calls = []

    def again(r):
        calls.append(r.wave)
        return spark.createDataFrame([("x", "r", "d", 0.0, True)], EVIDENCE.split(", ", 1)[1])

    run.run(None, again)
    assert calls == [3]
    assert {tuple(r) for r in run.known().collect()} == {("k0", 0, "given"), ("k1", 1, "promoted"), ("k2", 2, "promoted"), ("k3", 3, "promoted"), ("x", 4, "reconsidered"), ("y", 5, "registered")}


def test_reviews_hold_a_run_and_decisions_let_it_go_on(spark, tmp_path):
    evidence = [("k0", "a", "s", "k", 0.99, False), ("k0", "b", "s", "k", 0.99, False), ("k0", "w", "s", "k", 0.2, False), ("a", "c", "s", "k", 0.99, False), ("a", "w", "t", "k", 0.2, False), ("a", "b", "t", "k", 0.1, False)]
    start = lambda p: Waves(spark, p, buckets=2, manual=True).start(spark.createDataFrame([("k0",)], "seed_key string"), spark.createDataFrame(evidence, EVIDENCE))
    told = lambda **d: spark.createDataFrame(sorted(d.items()), "seed_key string, collect boolean")
    path = str(tmp_path)
    run = start(path).run()
    assert run.phase == "review" and sorted(r.seed_key for r in run.waiting().collect()) == ["a", "b"]
    run = Waves(spark, path, buckets=2, manual=True).run(told(a=True))
    assert run.phase == "review" and [r.seed_key for r in run.waiting(told(a=True)).collect()] == ["b"]
    run = Waves(spark, path, buckets=2, manual=True).run(told(a=True, b=False))
    # b was turned down, and its one weak signal since doesn't promote it again; c and w wait
    assert run.phase == "review" and run.wave == 1 and sorted(r.seed_key for r in run.waiting(told(a=True, b=False)).collect()) == ["c", "w"]
    run = Waves(spark, path, buckets=2, manual=True).run(told(a=True, b=False, c=False, w=True))
    assert run.phase == "done" and {tuple(r) for r in run.known().collect()} == {("k0", 0, "given"), ("a", 1, "reviewed"), ("w", 2, "reviewed")}


def test_a_broken_step_is_taken_again(spark, tmp_path, monkeypatch):
    evidence, seeds = _evidence(120, 40, 9), ["k1", "k2"]
    run = Waves(spark, str(tmp_path), buckets=2).start(spark.createDataFrame([(s,) for s in seeds], "seed_key string"), spark.createDataFrame(evidence, EVIDENCE))
    monkeypatch.setattr(Waves, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run.step()
    monkeypatch.undo()
    assert {tuple(r) for r in Waves(spark, str(tmp_path), buckets=2).run().known().collect()} == plain(seeds, evidence)


def test_a_wave_shuffles_its_sums_alone(spark, tmp_path):
    """Evidence and state are joined in their buckets: the only exchange of a wave carries its partial sums."""
    evidence = _evidence(200, 50, 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        run = Waves(spark, str(tmp_path), buckets=4).start(spark.createDataFrame([("k1",), ("k2",)], "seed_key string"), spark.createDataFrame(evidence, EVIDENCE))
        run.step()
        run.step()
        plan = run.delta()._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and re.search(r"Exchange hashpartitioning\(seed_key[^\n]*\n[^\n]*HashAggregate\(keys=\[seed_key|Exchange hashpartitioning\(seed_key[^\n]*\n[^\n]*SortAggregate", plan), plan
        saved = run._save(run.delta(), "sums", 2)
        plan = run.judged(run._table(saved[2], "sums"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_seeds_and_no_evidence(spark, tmp_path):
    none = spark.createDataFrame([], EVIDENCE)
    assert Waves(spark, str(tmp_path / "a"), buckets=2).start(none.select("seed_key"), none).run().known().collect() == []
    only = Waves(spark, str(tmp_path / "b"), buckets=2).start(spark.createDataFrame([("k",)], "seed_key string").select("seed_key", F.lit(1).alias("wave")), none).run()
    assert [tuple(r) for r in only.known().collect()] == [("k", 0, "given")]
