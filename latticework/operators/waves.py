"""Expansion in waves that work on what is new, and resume where they stopped.

Evidence is dealt once into buckets by its parent, all state into as many buckets by seed key. A wave joins its front with the evidence
of these parents bucket by bucket, sums it to one row for each candidate, and shuffles these rows alone. Earlier waves' sums are joined to
them in their buckets and never written again: a candidate's evidence is reasoned or not, a highest confidence, and its smallest and largest signal, which tell
whether there are two. Keys that are known are taken out the same way. So what a wave shuffles and writes follows its own evidence.

Phases: collect (waves of the front, while they promote something, at most ``waves``; a front of that depth is not asked any more), review (after each: a run
waits until every candidate held back has its decision), reconsider (candidates that others promote now), extra (one wave of
these; all candidates it touches are registered, and open no further wave), done. Each step ends with one small row that names the state's
tables; a step that broke off leaves the state as it was, and another session goes on from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "version bigint, phase string, wave int, tables array<struct<role: string, wave: int, name: string>>"
COLUMNS = {"evidence": "parent_key string, seed_key string, source string, kind string, confidence double, reasoned boolean", "known": "seed_key string, wave int, how string",
           "sums": "seed_key string, reasoned boolean, confidence double, low string, high string", "held": "seed_key string, wave int", "over": "seed_key string, wave int"}


class Waves:
    """A run below ``path``, a folder that driver and executors share; ``manual``: promoted candidates without a decision are held back for review."""

    def __init__(self, spark: SparkSession, path: str, waves: int = 3, buckets: int = 32, manual: bool = False, sure: float = 0.9) -> None:
        self.spark, self.path, self.waves, self.buckets, self.manual, self.sure = spark, path, waves, buckets, manual, sure
        self.version, self.phase, self.wave, self.tables = 0, "new", 0, []
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/steps")
        if root.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(root):
            row = spark.read.schema(STATE).parquet(f"{path}/steps").orderBy(F.desc("version")).first()
            if row is not None:
                self.version, self.phase, self.wave, self.tables = row.version, row.phase, row.wave, [tuple(t) for t in row.tables]

    def _commit(self, phase: str, wave: int, tables: list[tuple[str, int, str]]) -> None:
        row = (self.version + 1, phase, wave, [*self.tables, *tables])
        self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/steps")  # one file, there whole or not at all
        self.version, self.phase, self.wave, self.tables = row[0], phase, wave, row[3]

    def _save(self, rows: DataFrame, role: str, wave: int) -> tuple[str, int, str]:
        name, key = f"waves_{uuid.uuid4().hex}", "parent_key" if role == "evidence" else "seed_key"
        columns = [c.split(":")[0].split(" ")[0] for c in COLUMNS[role].split(", ")]
        rows.select(columns).repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{name}").saveAsTable(name)
        return role, wave, name

    def _table(self, name: str, role: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # another session wrote it
            key = "parent_key" if role == "evidence" else "seed_key"
            self.spark.sql(f"create table {name} ({COLUMNS[role]}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{self.path}/{name}'")
        return self.spark.table(name)

    def _all(self, role: str, wave: int | None = None) -> list[DataFrame]:
        return [self._table(name, r) for r, w, name in self.tables if r == role and wave in (None, w)]

    def start(self, seeds: DataFrame, evidence: DataFrame) -> Waves:
        """Begin with ``seeds`` (seed_key), to ask ``evidence`` (parent_key, seed_key, source, kind, confidence, reasoned); a run that has begun goes on instead."""
        if self.phase == "new":
            known = seeds.select("seed_key").distinct().select("seed_key", F.lit(0).alias("wave"), F.lit("given").alias("how"))
            self._commit("collect", 0, [self._save(known, "known", 0), self._save(evidence, "evidence", 0)])
        return self

    def delta(self) -> DataFrame:
        """The front's evidence, summed for each candidate that isn't known."""
        found = self._all("evidence")[0]
        for i, front in enumerate(self._all("known", self.wave)):
            parents = front.select(F.col("seed_key").alias("parent_key"))
            part = self._all("evidence")[0].join(parents, "parent_key", "left_semi")
            found = part if i == 0 else found.unionByName(part)
        return self._summed(found)

    def _summed(self, found: DataFrame) -> DataFrame:
        told = (F.col("source") != "") & (F.col("kind") != "")
        signal = F.when(told, F.concat_ws("|", "source", "kind"))
        rows = found.groupBy("seed_key").agg(F.coalesce(F.bool_or("reasoned"), F.lit(False)).alias("reasoned"), F.max(F.when(told, F.col("confidence"))).alias("confidence"), F.min(signal).alias("low"), F.max(signal).alias("high"))
        return reduce(lambda r, known: r.join(known, "seed_key", "left_anti"), self._all("known"), rows)

    def judged(self, sums: DataFrame) -> DataFrame:
        """Candidates of ``sums`` with whether all their evidence so far promotes them; what came before a candidate was held back or turned down doesn't count again."""
        rows = sums
        over = [(w, self._table(name, r)) for r, w, name in self.tables if r == "over"]
        rows = rows.withColumn("since", F.lit(-1))
        for w, gone in over:
            rows = rows.join(gone.select("seed_key", F.lit(w).alias("gone_")), "seed_key", "left").withColumn("since", F.greatest("since", F.coalesce("gone_", F.lit(-1)))).drop("gone_")
        for w, before in [(w, self._table(name, r)) for r, w, name in self.tables if r == "sums"]:
            old = before.select("seed_key", *(F.col(c).alias(f"{c}_") for c in ("reasoned", "confidence", "low", "high")))
            keep = lambda c, w=w: F.when(F.col("since") < w, F.col(f"{c}_"))
            rows = rows.join(old, "seed_key", "left").select(
                "seed_key", "since", (F.col("reasoned") | F.coalesce(keep("reasoned"), F.lit(False))).alias("reasoned"), F.greatest("confidence", keep("confidence")).alias("confidence"),
                F.least("low", keep("low")).alias("low"), F.greatest("high", keep("high")).alias("high"))
        promoted = F.col("reasoned") | (F.coalesce("confidence", F.lit(0.0)) >= self.sure) | F.coalesce(F.col("low") < F.col("high"), F.lit(False))
        return rows.select("seed_key", promoted.alias("promoted"))

    def _settle(self, sums: DataFrame, how: str, decisions: DataFrame | None, phase: str, weak: bool = False) -> None:
        """Store a wave's sums and what follows from them: new known keys, candidates held back, those whose evidence is used up."""
        w = self.wave + 1
        saved = self._save(sums, "sums", w)
        rows = self.judged(self._table(saved[2], "sums")).withColumn("collect", F.lit(None).cast("boolean") if self.manual else F.lit(True))
        if decisions is not None:
            told = decisions.groupBy("seed_key").agg(F.bool_or("collect").alias("told"))
            rows = rows.join(told, "seed_key", "left").withColumn("collect", F.coalesce("told", "collect"))
        verdict = self._save_verdict(rows, w)
        taken = verdict.filter(F.col("promoted") & F.col("collect") | (~F.col("promoted") if weak else F.lit(False)))
        out = [saved, self._save(taken.select("seed_key", F.lit(w).alias("wave"), F.lit(how).alias("how")), "known", w)]
        out.append(self._save(verdict.filter("promoted and collect is null").select("seed_key", F.lit(w).alias("wave")), "held", w))
        out.append(self._save(verdict.filter("promoted and not coalesce(collect, false)").select("seed_key", F.lit(w).alias("wave")), "over", w))
        self._commit(phase, self.wave, out)

    def _save_verdict(self, rows: DataFrame, w: int) -> DataFrame:
        path = f"{self.path}/verdict_{uuid.uuid4().hex}"
        rows.select("seed_key", "promoted", "collect").write.parquet(path)
        return self.spark.read.schema("seed_key string, promoted boolean, collect boolean").parquet(path)

    def waiting(self, decisions: DataFrame | None = None) -> DataFrame:
        """Candidates held back that have no decision (seed_key, collect) yet."""
        held = reduce(DataFrame.unionByName, self._all("held", self.wave + 1)) if self._all("held", self.wave + 1) else self.spark.createDataFrame([], COLUMNS["held"])
        return held.select("seed_key") if decisions is None else held.select("seed_key").join(decisions.filter("collect is not null"), "seed_key", "left_anti")

    def step(self, decisions: DataFrame | None = None, reconsidered: Callable[[Waves], DataFrame] | None = None) -> bool:
        """One phase; False if the run waits for decisions or is done. ``reconsidered``: gives candidates (seed_key, source, kind, confidence, reasoned)
        that are worth another look, from the run."""
        if self.phase == "collect":
            if self.wave >= self.waves:
                self._commit("reconsider", self.wave, [])
            else:
                self._settle(self.delta(), "promoted", decisions, "review")
        elif self.phase in ("review", "review extra"):
            if not self.waiting(decisions).isEmpty():
                return False
            w, new = self.wave + 1, []
            if decisions is not None and self._all("held", w):
                late = reduce(DataFrame.unionByName, self._all("held", w)).join(decisions.filter("collect").select("seed_key").distinct(), "seed_key", "left_semi")
                new = [self._save(late.select("seed_key", F.lit(w).alias("wave"), F.lit("reviewed").alias("how")), "known", w)]
            front = [*self._all("known", w), *(self._table(n, r) for r, _, n in new)]
            if all(f.isEmpty() for f in front):
                self._commit("reconsider" if self.phase == "review" else "done", self.wave, new)
            else:
                self._commit("collect" if self.phase == "review" else "extra", w, new)
        elif self.phase == "reconsider":
            if reconsidered is None:
                self._commit("done", self.wave, [])
            else:
                self._settle(self._summed(reconsidered(self)), "reconsidered", decisions, "review extra")
        elif self.phase == "extra":
            self._settle(self.delta(), "registered", decisions, "done", weak=True)
        return self.phase != "done"

    def run(self, decisions: DataFrame | None = None, reconsidered: Callable[[Waves], DataFrame] | None = None) -> Waves:
        """Step until the run is done or waits for decisions; the number of steps is bounded by the number of waves."""
        while self.phase != "done" and self.step(decisions, reconsidered):
            pass
        return self

    def discarded(self) -> DataFrame:
        """Candidates (seed_key) that evidence told of and that are not known."""
        seen = [t.select("seed_key") for t in self._all("sums")]
        if not seen:
            return self.spark.createDataFrame([], "seed_key string")
        rows = reduce(DataFrame.unionByName, seen).distinct()
        return reduce(lambda r, known: r.join(known, "seed_key", "left_anti"), self._all("known"), rows)

    def known(self) -> DataFrame:
        """All seeds: seed_key, wave (0: given), how."""
        return reduce(DataFrame.unionByName, self._all("known"))

    def close(self) -> None:
        """Forget the tables' names; their files stay, and a run that is opened again finds them."""
        for _, _, name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
