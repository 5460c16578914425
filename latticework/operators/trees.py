"""Each asset's lineage as a tree of rows, and the lines that each node tells, from one pass over the sightings.

Sightings are read once, with their asset's id; what repeats among them is folded once to one row for each (asset, enumeration, source), which is
a contributor. Seeds, enrichment stages and totals are one aggregate over these rows by (asset, group, leaf), and groups one over that. Nodes and
lines are projections of the four stored tables, so a source is scanned once however many kinds of nodes there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import stored


def tree_tables(assets: DataFrame, sightings: DataFrame, enumerations: DataFrame, seeds: DataFrame) -> dict[str, DataFrame]:
    """What trees are made of, stored.

    ``assets``: type, asset_key, asset_id, ownership_state, root. ``sightings``: type, asset_key, id, kind, identifier, source, enumeration_id, ownership_state, inclusion_reason,
    seen_us. ``enumerations``: id, seed_id. ``seeds``: id, company_name, domain. Sightings without an asset don't count.
    """
    by = ["type", "asset_key"]
    own = stored(assets.select(*by, "asset_id", "ownership_state", "root"), "assets")
    facts = stored(sightings.join(own.select(*by, "asset_id"), by).drop("asset_key"), "facts")
    told = enumerations.select(F.col("id").alias("enumeration_id"), F.col("seed_id").alias("of_seed")).join(seeds.select(F.col("id").alias("of_seed"), F.coalesce("company_name", F.lit("")).alias("label"), "domain"), "of_seed", "left")
    combos = facts.groupBy("asset_id", "enumeration_id", "source").agg(F.count("*").alias("n"), F.count_if(F.col("kind") != "enrichment").alias("found"), F.min("seen_us").alias("first_us"), F.max("seen_us").alias("last_us"))
    combos = stored(combos.join(told, "enumeration_id", "left").withColumn("seed_id", F.coalesce("of_seed", F.lit(""))).withColumn("label", F.coalesce("label", F.lit(""))), "contributors")
    leaf = lambda group, name, label: F.struct(F.lit(group).alias("grp"), name.alias("leaf"), label.alias("leaf_label"))
    none = F.lit("")
    kinds = F.array_compact(F.array(leaf("observations", none, none), leaf("seeds", F.col("seed_id"), F.col("label")), F.when(F.col("n") > F.col("found"), leaf("enrichment", F.col("source"), none))))
    leaves = combos.select("asset_id", "enumeration_id", "source", "n", "found", "first_us", "last_us", F.inline(kinds)).groupBy("asset_id", "grp", "leaf", "leaf_label").agg(
        F.count("*").alias("contributors"), F.sum("n").alias("n"), F.sum("found").alias("found"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("enumeration_id")).alias("enumerations"))
    return {"assets": own, "facts": facts, "contributors": combos, "leaves": stored(leaves, "leaves")}


def _ids(group: str) -> tuple[Column, Column]:
    root = F.concat(F.lit("asset:"), "asset_id")
    return root, F.concat(root, F.lit(f":{group}"))


def nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (asset_id, id, parent_id, kind, label, subtitle, badges): the asset, its groups, and their leaves."""
    def node(rows: DataFrame, id: Column, parent: Column, kind: str, label: Column, subtitle: Column, badges: Column) -> DataFrame:
        return rows.select("asset_id", id.alias("id"), parent.alias("parent_id"), F.lit(kind).alias("kind"), label.alias("label"), subtitle.alias("subtitle"), badges.alias("badges"))

    own, leaves, none = tables["assets"], tables["leaves"], F.lit("")
    related = own.filter("root <> asset_key")
    parts = [node(own, _ids("")[0], F.lit(None).cast("string"), "asset", F.col("asset_key"), F.col("type"), F.col("ownership_state"))]
    counted = leaves.groupBy("asset_id", "grp").agg(F.count("*").alias("leaves"), F.sum("n").alias("n"))
    title = F.when(F.col("grp") == "observations", "Observations").when(F.col("grp") == "seeds", "Seed Context").otherwise("Enrichment")
    text = lambda c: F.col(c).cast("string")
    what = F.when(F.col("grp") == "observations", F.concat(text("n"), F.lit(" supporting observations"))).when(F.col("grp") == "seeds", F.concat(text("leaves"), F.lit(" contributing seeds"))).otherwise("Runtime cache and enrichment results")
    parts.append(node(counted, F.concat(_ids("")[1], "grp"), _ids("")[0], "group", title, what, none))
    parts.append(node(related, _ids("relations")[1], _ids("")[0], "group", F.lit("Relations"), F.lit("1 linked discovery edges"), none))
    parts.append(node(tables["facts"], F.concat(F.lit("obs:"), "id"), _ids("observations")[1], "observation", F.col("source"), F.col("identifier"), F.initcap("kind")))
    parts.append(node(leaves.filter("grp = 'seeds'"), F.concat(F.lit("seed:"), "leaf"), _ids("seeds")[1], "seed", F.col("leaf_label"), F.col("leaf"), F.concat(text("contributors"), F.lit(" contributors"))))
    parts.append(node(related, F.concat(F.lit("rel:rel-"), "asset_id"), _ids("relations")[1], "relation", F.lit("same_root"), F.col("root"), F.lit("same_root")))
    parts.append(node(leaves.filter("grp = 'enrichment'"), F.concat(F.lit("enrich:"), "asset_id", F.lit(":"), "leaf"), _ids("enrichment")[1], "enrichment", F.col("leaf"), F.lit("completed"), none))
    return reduce(DataFrame.unionByName, parts)


def details(tables: dict[str, DataFrame]) -> DataFrame:
    """Lines (asset_id, id, title, position, item) of observations, contributors, relations, enrichment stages and the observations as a whole; a line without a value is
    left out, and so is a section without lines. The texts before the colons are fixed values."""
    def day(c: str) -> Column:
        return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")

    def sections(rows: DataFrame, id: Column, told: dict[str, list[tuple[str, Column]]]) -> DataFrame:
        lines = lambda xs: F.array_compact(F.array(*(F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) != "", F.concat(F.lit(f"{text}: "), c.cast("string"))) for text, c in xs)))
        every = F.array(*(F.struct(F.lit(title).alias("title"), lines(xs).alias("items")) for title, xs in told.items()))
        return rows.select("asset_id", id.alias("id"), F.explode(every).alias("s")).select("asset_id", "id", "s.title", F.posexplode("s.items").alias("position", "item"))

    c, combos = F.col, tables["contributors"]
    dims = combos.filter("of_seed is not null").select("enumeration_id", "of_seed", "label", "domain").distinct()
    seen = tables["facts"].join(dims, "enumeration_id", "left")
    known = c("of_seed").isNotNull()
    parts = [sections(seen, F.concat(F.lit("obs:"), "id"), {
        "Observation": [("Observation ID", c("id")), ("Kind", c("kind")), ("Type", c("type")), ("Identifier", c("identifier")), ("Source", c("source")), ("Discovered at", day("seen_us")), ("Ownership state", c("ownership_state")), ("Inclusion reason", c("inclusion_reason"))],
        "Enumeration": [("Enumeration ID", F.when(known, c("enumeration_id"))), ("Seed ID", c("of_seed"))],
        "Seed Context": [("Seed ID", c("of_seed")), ("Company", c("label")), ("Seed domains", c("domain"))]})]
    index = F.row_number().over(Window.partitionBy("asset_id", "seed_id").orderBy("first_us", "enumeration_id", "source")) - 1
    numbered = combos.withColumn("index", index.cast("string"))
    parts.append(sections(numbered, F.concat(F.lit("seed:"), "seed_id", F.lit(":contributor:"), "index"), {"Contributor": [("Source", c("source")), ("Enumeration ID", c("enumeration_id")), ("Originating asset ID", c("asset_id")), ("Discovered at", day("first_us"))]}))
    related = tables["assets"].filter("root <> asset_key")
    parts.append(sections(related, F.concat(F.lit("rel:rel-"), "asset_id"), {"Relation": [("Kind", F.lit("same_root"))], "Endpoints": [("From", c("asset_key")), ("To", c("root"))]}))
    stages = tables["leaves"].filter("grp = 'enrichment'")
    parts.append(sections(stages, F.concat(F.lit("enrich:"), "asset_id", F.lit(":"), "leaf"), {"Enrichment State": [("Stage", c("leaf")), ("Status", F.lit("completed"))]}))
    whole = tables["leaves"].filter("grp = 'observations'")
    parts.append(sections(whole, _ids("observations")[1], {"Observation Summary": [
        ("Total observations", c("n")), ("Discovery observations", c("found")), ("Enrichment observations", c("n") - c("found")), ("Sources", F.array_join("sources", ", ")),
        ("Enumerations", F.array_join("enumerations", ", ")), ("First seen", day("first_us")), ("Last seen", day("last_us"))]}))
    return reduce(DataFrame.unionByName, parts)
