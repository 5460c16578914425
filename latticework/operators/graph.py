"""Relations between assets, networks, and assets related by root or enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.keys import asset_key, ip4_number, ip_bits


def resolve_endpoints(relations: DataFrame, assets: DataFrame) -> DataFrame:
    """Edges with the asset ids of both ends, null where an end is no asset; edges of equal content once."""
    ids = assets.select(asset_key(F.col("identifier")).alias("k"), "asset_id")
    out = relations.dropDuplicates(["id", "from_identifier", "to_identifier", "kind"])
    for end in ("from", "to"):
        side = ids.select(F.col("k").alias(f"{end}_k"), F.col("asset_id").alias(f"{end}_asset_id"))
        out = out.join(side, asset_key(F.col(f"{end}_identifier")) == F.col(f"{end}_k"), "left").drop(f"{end}_k")
    return out


#: What makes two edges the same one.
EDGE_KEY = ["from_asset_id", "from_asset_type", "from_identifier", "to_asset_id", "to_asset_type", "to_identifier", "observation_id", "enumeration_id", "source", "kind", "label", "reason", "discovery_date"]


def distinct_edges(relations: DataFrame) -> DataFrame:
    """Edges of which no two agree in all that tells them apart (columns that are missing count as equal); of those that do, that of the smallest id."""
    by = [c for c in EDGE_KEY if c in relations.columns]
    rest = [c for c in relations.columns if c not in by]
    return relations.groupBy(*by).agg(F.min(F.struct(*(["id"] if "id" in rest else []), *(c for c in rest if c != "id"))).alias("_r")).select(*by, "_r.*") if rest else relations.dropDuplicates(by)


def provenance(observations: DataFrame) -> DataFrame:
    """Per type and asset_key the distinct sightings (asset_id, enumeration_id, source, seen_us) in order of date, those without one last."""
    key = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("asset_id", "enumeration_id", "source")))
    item = F.struct(F.col("seen_us").isNull().alias("late"), F.col("seen_us"), key.alias("key"), F.col("asset_id"), F.col("enumeration_id"), F.col("source"))
    known = observations.filter("coalesce(asset_id, '') <> '' or coalesce(enumeration_id, '') <> '' or coalesce(source, '') <> '' or seen_us is not null")
    told = known.groupBy("type", "asset_key").agg(F.array_sort(F.collect_set(item)).alias("p"))
    return told.select("type", "asset_key", F.transform("p", lambda x: F.struct(x.asset_id.alias("asset_id"), x.enumeration_id.alias("enumeration_id"), x.source.alias("source"), x.seen_us.alias("seen_us"))).alias("provenance"))


def stray_observations(observations: DataFrame, assets: DataFrame) -> DataFrame:
    """Sightings (id, asset_id) without an asset id, or with one that no asset has, and which."""
    known = assets.select("asset_id", F.lit(True).alias("known")).distinct()
    rows = observations.select("id", F.nullif("asset_id", F.lit("")).alias("asset_id")).join(known, "asset_id", "left")
    return rows.select("id", F.when(F.col("asset_id").isNull(), "without").when(F.col("known").isNull(), "unknown").alias("issue")).filter("issue is not null")


def dangling(resolved: DataFrame) -> DataFrame:
    """Edges with an end that is no asset, and which."""
    missing = F.concat_ws(",", F.when(F.col("from_asset_id").isNull(), "from"), F.when(F.col("to_asset_id").isNull(), "to"))
    return resolved.select("id", missing.alias("missing")).filter("missing <> ''")


def relation_summary(resolved: DataFrame) -> DataFrame:
    """Per asset: its edges (a self-loop once), peers and kinds."""
    edge = F.explode(F.array_distinct(F.array(F.struct(F.col("from_asset_id").alias("a"), F.col("to_asset_id").alias("b")), F.struct(F.col("to_asset_id").alias("a"), F.col("from_asset_id").alias("b")))))
    ends = resolved.filter("from_asset_id is not null and to_asset_id is not null").select("id", "kind", edge.alias("e"))
    return ends.groupBy(F.col("e.a").alias("asset_id")).agg(F.count("*").alias("relations"), F.count_distinct("e.b").alias("peers"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def ip_in_cidr(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs (ip, cidr) of addresses inside prefixes (cidr, base, len): equality of masked keys for the lengths that occur, no range join."""
    lens = prefixes.select("len").distinct().agg(F.sort_array(F.collect_list("len")).alias("lens"))  # 33 lengths at most
    n = ips.select("ip", ip4_number(F.col("ip")).alias("n")).filter("n is not null").distinct().join(F.broadcast(lens))
    keys = n.select("ip", "n", F.explode("lens").alias("len")).withColumn("base", F.expr("n - n % shiftleft(1L, 32 - len)"))
    return keys.join(prefixes, ["len", "base"]).select("ip", "cidr")


def addresses_in_prefixes(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs (ip, cidr) of addresses of either kind inside prefixes (cidr): equality of their first bits, for the lengths that occur; what is no address or prefix takes no part."""
    # each spelling is read once: the count and the array keep the optimizer from reading every row, and from reading it again for each use
    once = lambda df, c: df.groupBy(c).agg(F.count("*").alias("rows"))
    read = lambda c: F.explode(F.array_compact(F.array(F.when(F.col("rows") > 0, ip_bits(c))))).alias("bits")
    parts = F.split("cidr", "/")
    p = once(prefixes, "cidr").select("cidr", F.get(parts, F.lit(1)).try_cast("int").alias("len"), read(parts[0])).filter("len between 0 and length(bits)")
    p = p.select("cidr", F.length("bits").alias("width"), "len", F.substring("bits", F.lit(1), F.col("len")).alias("head"))
    lens = p.select("width", "len").distinct()  # 162 at most
    a = once(ips, "ip").select("ip", read(F.col("ip")))
    a = a.join(F.broadcast(lens), F.length("bits") == F.col("width")).select("ip", "width", "len", F.substring("bits", F.lit(1), F.col("len")).alias("head"))
    return a.join(p, ["width", "len", "head"]).select("ip", "cidr")


def related_assets(assets: DataFrame, most: int = 8) -> DataFrame:
    """Per asset at most ``most`` others: those of its registrable root first, then of its enumeration, in row order.

    Each asset needs only the first ``most + 1`` members of its root and of its enumeration, so these are cut before they
    are joined: the work grows with the assets, not with the square of a group.
    """
    def lead(group: str, kind: int) -> DataFrame:
        w = Window.partitionBy(group).orderBy("pos")
        top = assets.filter(F.col(group).isNotNull()).select(group, F.col("asset_id").alias("other"), "pos").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * most + 1)
        tops = top.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "other"))).alias("t"))
        return assets.select("asset_id", group).join(tops, group).select("asset_id", F.explode("t").alias("t")).select("asset_id", F.lit(kind).alias("kind"), "t.pos", "t.other")

    both = lead("root", 1).union(lead("enumeration_id", 2)).filter("asset_id <> other")
    first = both.groupBy("asset_id", "other").agg(F.min(F.struct("kind", "pos")).alias("k"))
    w = Window.partitionBy("asset_id").orderBy("k")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("asset_id", "rank", "other", F.when(F.col("k.kind") == 1, "Same Registrable Domain").otherwise("Same Enumeration").alias("label"))
