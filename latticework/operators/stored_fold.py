"""The fold of sightings into stored assets: a batch touches the states of its own keys only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.operators.fold import finished, fold_states, merge_states, provenance, with_provenance
from latticework.session import stored
from latticework.sources.keyed import KeyedTable

SIGHTING = "seq bigint, id string, enumeration_id string, type string, identifier string, source string, kind string, ownership_state string, inclusion_reason string, seen_us bigint"
KEY, SEEN = ["type", "asset_key"], ["type", "asset_key", "id", "enumeration_id", "source", "seen_us"]


class AssetStore:
    """Assets below ``path`` as mergeable states by key, beside the distinct provenance that their counts need."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        none = spark.createDataFrame([], SIGHTING)
        self.states = KeyedTable(spark, f"{path}/states", with_provenance(fold_states(none), provenance(none)).schema, KEY)
        self.seen = KeyedTable(spark, f"{path}/seen", provenance(none).schema, SEEN)

    def add(self, obs: DataFrame, batch: int) -> None:
        """Fold a batch in; batches are numbered from 0 and come in order, one that runs again after it broke off counts once."""
        if batch > self.seen.version or batch + 1 < self.seen.version:
            raise ValueError(f"batch {self.seen.version} is next")
        if batch < self.seen.version:
            return
        fresh = provenance(obs)
        known = self.seen.read(fresh)
        fresh = stored(fresh.alias("f").join(known.alias("k"), [fresh[c].eqNullSafe(known[c]) for c in SEEN], "left_anti"), "fresh")
        if self.states.version == batch:
            new = stored(with_provenance(fold_states(obs), fresh), "new")
            old = self.states.read(new)
            old = old.join(new.select(KEY), [old[c].eqNullSafe(new[c]) for c in KEY], "left_semi")
            self.states.write(merge_states(old.unionByName(new)))
        self.seen.write(fresh)

    def assets(self) -> DataFrame:
        """Canonical assets of all batches."""
        return finished(self.states.read())
