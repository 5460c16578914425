"""The fold of sightings into canonical assets, and what is derived beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.keys import asset_key, trimmed
from latticework.session import stored

#: Ownership states by rank.
STATES = ["", "associated_infrastructure", "uncertain", "owned"]


def state_rank(c: Column) -> Column:
    return F.coalesce(sum((F.when(c == s, i).otherwise(0) for i, s in enumerate(STATES) if i), F.lit(0)), F.lit(0))


def explicit(reason: Column) -> Column:
    """A reason that was given, not one that was derived."""
    r = trimmed(reason)
    return (r != "") & ~r.startswith("Discovered via ") & ~(r.startswith("Supported by ") & r.contains(" discovery observations"))


def ranked_observations(obs: DataFrame, range_rows: int = 1 << 16) -> DataFrame:
    """Each observation with its key, whether it is the key's first, its rank (the first takes its type's default), the rank before it and whether it raised it.

    Observations are dealt into ranges of (key, seq) of about ``range_rows``, so a key that very many share is split. A range knows the ranks inside it; what came
    before is the highest rank of the key's earlier ranges, of which a table with a row for each key and range tells.
    """
    by, whole = ["type", "asset_key"], obs.withColumn("asset_key", asset_key(F.col("identifier")))
    ranges = max(1, -(-obs.count() // range_rows))
    own, default = state_rank(F.col("ownership_state")), F.when(F.col("type") == "ip", 1).otherwise(3)
    dealt = whole.repartitionByRange(ranges, *by, "seq").withColumn("_part", F.spark_partition_id()).withColumn("_own", own)
    dealt = stored(dealt, "ranges")
    chunks = dealt.groupBy("_part", *by).agg(F.max("_own").alias("_top"), F.min_by("_own", "seq").alias("_start"))
    w = Window.partitionBy(*by).orderBy("_part")
    begins = F.row_number().over(w) == 1
    chunks = chunks.withColumn("_begins", begins).withColumn("_top", F.when(F.col("_begins") & (F.col("_start") == 0), F.greatest("_top", default)).otherwise(F.col("_top")))
    chunks = chunks.withColumn("_earlier", F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, -1))).drop("_top", "_start")
    left, right = dealt.alias("d"), chunks.alias("c")
    rows = left.join(right, [F.col("d._part") == F.col("c._part"), *(F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in by)]).select("d.*", "c._begins", "c._earlier")
    inside = Window.partitionBy("_part", *by).orderBy("seq")
    rows = rows.withColumn("first", F.col("_begins") & (F.row_number().over(inside) == 1))
    rows = rows.withColumn("rank", F.when(F.col("first") & (F.col("_own") == 0), default).otherwise(F.col("_own")))
    rows = rows.withColumn("before", F.coalesce(F.greatest("_earlier", F.max("rank").over(inside.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0)))
    return rows.withColumn("raised", F.col("rank") > F.col("before")).drop("_part", "_own", "_begins", "_earlier")


def source_parts(source: Column) -> Column:
    """The single sources that a comma-separated value names, lower case."""
    return F.filter(F.transform(F.split(F.lower(source), ","), trimmed), lambda x: x != "")


def fold_states(obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The fold's state per (type, key): all of what canonical assets are made of, but for the number of distinct provenances.

    States of parts of a table merge to the state of the whole (``merge_states``), in any grouping and order: each field is a
    minimum, maximum, sum or set, ordered ones by ``seq``. ``first`` is the key's first sighting, ``fit`` the first that discovery made
    with an explicit reason, ``rank1`` and so on the first of at least that ownership: only these can have given the reason. ``by``: further
    columns that split a key's state, which ``merge_states`` takes together again.
    """
    rows = obs.select(
        "type", asset_key(F.col("identifier")).alias("asset_key"), *(by or []), "seq", "id", "enumeration_id", "source", "seen_us", (F.col("kind") == "discovery").alias("found"),
        state_rank(F.col("ownership_state")).alias("own"), explicit(F.col("inclusion_reason")).alias("given"), trimmed(F.col("inclusion_reason")).alias("reason"), F.lower(trimmed(F.col("source"))).alias("low"))
    found, own, given, reason, source = (F.col(c) for c in ("found", "own", "given", "reason", "low"))
    fit = F.struct("seq", reason.alias("reason"), (found & given).alias("fit"))
    return rows.groupBy("type", "asset_key", *(by or [])).agg(
        F.min_by(F.struct("seq", "id", "enumeration_id", "source", own.alias("own"), given.alias("given"), reason.alias("reason"), found.alias("found")), "seq").alias("first"),
        F.min("seen_us").alias("first_seen_us"), F.max(own).alias("top"), F.count("*").alias("observations"), F.count_if(found).alias("n_found"),
        F.array_distinct(F.flatten(F.transform(F.collect_set(F.when(found, F.col("source"))), source_parts))).alias("parts"), F.collect_set(F.when(found & (source != ""), source)).alias("whole"),
        F.min_by(fit, F.when(found & given, F.col("seq"))).alias("fit"), *(F.min_by(fit, F.when(own >= r, F.col("seq"))).alias(f"rank{r}") for r in range(1, len(STATES))),
    )


def merge_states(states: DataFrame, by: tuple[str, ...] = ("type", "asset_key")) -> DataFrame:
    """States of the same keys merged to one each; counts that ``states`` has beside them (n_provenance) add up."""
    firsts = ["first", "fit", *(f"rank{r}" for r in range(1, len(STATES)))]
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    return states.groupBy(*by).agg(
        *(F.min_by(c, f"{c}.seq").alias(c) for c in firsts), F.min("first_seen_us").alias("first_seen_us"), F.max("top").alias("top"),
        *(F.sum(c).alias(c) for c in ("observations", "n_found", "n_provenance") if c in states.columns), union("parts"), union("whole"),
    )


def provenance(obs: DataFrame) -> DataFrame:
    """Distinct provenance (id, enumeration, source, date) of discovery's sightings per (type, key)."""
    return obs.filter("kind = 'discovery'").select("type", asset_key(F.col("identifier")).alias("asset_key"), "id", "enumeration_id", "source", "seen_us").distinct()


def with_provenance(states: DataFrame, seen: DataFrame) -> DataFrame:
    """``states`` with the number of their keys' rows in ``seen`` (``provenance``)."""
    n = seen.groupBy("type", "asset_key").agg(F.count("*").alias("n_provenance"))
    return states.join(n, ["type", "asset_key"], "left").withColumn("n_provenance", F.coalesce("n_provenance", F.lit(0)))


def _begin(own: Column) -> Column:
    """The rank that a key's first sighting gives it: its own, or its type's default."""
    return F.when(own > 0, own).otherwise(F.when(F.col("type") == "ip", 1).otherwise(3))


def _state(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), rank + 1)


def asset_ids(obs: DataFrame) -> DataFrame:
    """type, asset_key, asset_id and ownership_state of the canonical assets alone: without sources, reasons and the distinct provenance that those take."""
    rows = obs.select("type", asset_key(F.col("identifier")).alias("asset_key"), "seq", "id", state_rank(F.col("ownership_state")).alias("own"))
    out = rows.groupBy("type", "asset_key").agg(F.min_by(F.struct("id", "own"), "seq").alias("first"), F.max("own").alias("top"))
    return out.select("type", "asset_key", F.col("first.id").alias("asset_id"), _state(F.greatest("top", _begin(F.col("first.own")))).alias("ownership_state"))


def finished(out: DataFrame) -> DataFrame:
    """Canonical assets from whole states (``fold_states``, merged) with n_provenance.

    The reason is that of the first eligible observation (an explicit reason, seen by discovery or first of all), or of a later
    one that raised the ownership: for each rank only the earliest observation that has it can. Without any it is derived from
    the discovery observations' provenance.
    """
    out = out.withColumn("begin", _begin(F.col("first.own"))).withColumn("rank", F.greatest("top", "begin")).withColumn("whole", F.array_sort("whole"))
    told = lambda c: F.struct(F.col(f"{c}.seq").alias("seq"), F.col(f"{c}.reason").alias("reason"))
    raised = [F.when((F.col("begin") < r) & F.col(f"rank{r}.fit"), told(f"rank{r}")) for r in range(1, len(STATES))]
    best = F.array_max(F.array_compact(F.array(F.when(F.col("first.given"), told("first")).when(F.col("fit.fit"), told("fit")), *raised)))
    names = F.array_join("whole", ", ")
    supported = (
        F.when(F.size("whole") == 0, F.concat(F.lit("Supported by "), F.col("n_provenance").cast("string"), F.lit(" discovery observations")))
        .when(F.col("n_provenance") == 1, F.concat(F.lit("Discovered via "), F.col("whole")[0]))
        .otherwise(F.concat(F.lit("Supported by "), F.col("n_provenance").cast("string"), F.lit(" discovery observations from "), names))
    )
    later = F.col("n_found") > F.col("first.found").cast("int")
    why = F.when(best.isNotNull(), best.reason).when(later, supported).otherwise(F.concat(F.lit("Discovered via "), F.col("first.source")))
    return out.select("type", "asset_key", F.col("first.id").alias("asset_id"), F.col("first.enumeration_id").alias("enumeration_id"), "first_seen_us", F.array_join(F.array_sort("parts"), ", ").alias("sources"), _state(F.col("rank")).alias("ownership_state"), why.alias("inclusion_reason"), "observations")


def canonical_assets(obs: DataFrame) -> DataFrame:
    """One row per (type, key): first id and enumeration, earliest date, sources, highest ownership, inclusion reason.

    Everything is an aggregate that map tasks combine, so an address that very many sightings share is no large group. Distinct
    provenance is counted beside the states, so that no state travels once for each of them.
    """
    return finished(with_provenance(fold_states(obs), provenance(obs)))


#: States of an enrichment stage by priority.
STAGES = ["failed", "retryable", "cached", "completed"]
#: Kinds of DNS records that show a live name.
LIVE = ["A", "AAAA", "MX", "NS"]


def merged_details(obs: DataFrame) -> DataFrame:
    """What sightings tell of an asset, folded per (type, key).

    ``obs`` has, besides type, identifier and seq, records array<struct<type,value>>, is_catch_all, rdap (a struct of strings and
    arrays of strings), asn, organization, ptr, data map<string,string> and states map<string,struct<status,updated_us>>; all may be null. Records: distinct, by type and value.
    Registration and address fields: the first that is not empty; arrays united. Data: the last value of each key. States: that
    of highest priority for each key, the later of equal ones.
    """
    by = ["type", "asset_key"]
    rows = obs.withColumn("asset_key", asset_key(F.col("identifier")))
    first = lambda c: F.min_by(c, F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "0"), None).otherwise(F.col("seq")))
    fields = []
    for f in obs.schema["rdap"].dataType.fields:
        c = F.col(f"rdap.{f.name}")
        fields.append((F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))) if f.dataType.typeName() == "array" else first(c)).alias(f.name))
    record = F.transform("records", lambda r: F.struct(F.upper(trimmed(r["type"])).alias("type"), F.lower(trimmed(r["value"])).alias("value")))
    plain = rows.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(record)))).alias("records"), F.coalesce(F.bool_or("is_catch_all"), F.lit(False)).alias("is_catch_all"),
        *fields, *(first(F.col(c)).alias(c) for c in ("asn", "organization", "ptr")),
    ).select(*by, "records", "is_catch_all", F.struct(*(f.name for f in obs.schema["rdap"].dataType.fields)).alias("rdap"), "asn", "organization", "ptr")
    entry = lambda c, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", v)))).alias(c)
    data = rows.select(*by, "seq", F.explode("data")).groupBy(*by, "key").agg(F.max_by("value", "seq").alias("value")).groupBy(*by).agg(entry("data", "value"))
    priority = F.array_position(F.array(*map(F.lit, STAGES)), F.lower(trimmed(F.col("value.status"))))
    states = rows.select(*by, "seq", F.explode("states")).groupBy(*by, "key").agg(F.max_by("value", F.struct(priority, "seq")).alias("value")).groupBy(*by).agg(entry("states", "value"))
    return plain.join(data, by, "left").join(states, by, "left")


def resolution_status(kind: Column, records: Column, states: Column, stage: str = "domain_enricher") -> Column:
    """Whether a domain resolves, by its records and how its enrichment ended; null for addresses."""
    status = F.lower(trimmed(F.try_element_at(states, F.lit(stage)).status))
    return F.when(kind == "domain", F.when(F.size(records) > 0, "resolved").when(status.isin("completed", "cached"), "unresolved").when(status.isin("failed", "retryable"), "lookup_failed").otherwise("not_checked"))


def live_dns(records: Column) -> Column:
    """Whether records show a live name: text records and aliases alone do not."""
    return F.exists(records, lambda r: F.upper(r["type"]).isin(LIVE))


def merge_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds of one key become one: the first id, company, address and industry that are not empty, highest confidence, arrays united; counted are
    the seeds and the companies beside the first (whose names ``seed_evidence`` keeps)."""
    company = F.lower(trimmed(F.col("company_name")))
    have = set(seeds.columns)
    first = [F.min_by(c, F.when(trimmed(F.col(c)) != "", F.col("seq"))).alias(c) for c in ("id", "company_name", "address", "industry") if c in have]
    arrays = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("asn",) if c in have]
    low = lambda c: F.filter(F.transform(c, lambda x: F.lower(trimmed(x))), lambda x: x != "")
    arrays += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(low(c))))).alias(c) for c in ("cidr", "tags") if c in have]
    grouped = seeds.groupBy(F.lower(trimmed(F.col("domain"))).alias("seed_key")).agg(*first, F.max("confidence").alias("confidence"), *arrays, F.count("*").alias("merged"), F.count_distinct(F.when(company != "", company)).alias("companies"))
    return grouped.withColumn("conflicts", F.greatest(F.col("companies") - 1, F.lit(0))).drop("companies")


def seed_evidence(seeds: DataFrame) -> DataFrame:
    """Evidence (seed_key, source, kind, value) of merged seeds: what each came with (evidence: array of source, kind, value), and names of companies
    other than the first."""
    rows = seeds.withColumn("seed_key", F.lower(trimmed(F.col("domain"))))
    company = F.lower(trimmed(F.col("company_name")))
    first = rows.filter(company != "").groupBy("seed_key").agg(F.min_by(company, "seq").alias("first"))
    other = rows.filter(company != "").select("seed_key", company.alias("value")).distinct().join(first, "seed_key").filter("value <> first")
    out = other.select("seed_key", F.lit("seed_merge").alias("source"), F.lit("company_name").alias("kind"), "value")
    if "evidence" in seeds.columns:
        own = rows.select("seed_key", F.inline("evidence"))
        out = out.union(own.select("seed_key", *(F.lower(trimmed(F.col(c))) for c in ("source", "kind", "value"))))
    return out.filter("source <> '' or kind <> '' or value <> ''").distinct()
