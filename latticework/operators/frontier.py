"""Expansion in bounded waves: seeds that promote further seeds, pages and sitemaps that lead to more, a second look at rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.judged import confidence_gate, promote_candidates
from latticework.session import stored

#: Path extensions that are no pages.
ASSET_EXTENSIONS = [
    "7z", "avi", "bz2", "css", "eot", "gif", "gz", "ico", "jar", "jpeg", "jpg", "js", "json", "map", "mov", "mp3", "mp4", "pdf", "png", "svg", "tar", "tgz", "ttf", "txt", "wav", "webm", "woff", "woff2", "xml", "zip",
]


def followable(url):
    """Whether a URL may be a page, by the extension of its path."""
    return ~F.lower(F.regexp_extract(url, r"^[^?#]*/[^/?#]*\.([A-Za-z0-9]+)(?:[?#]|$)", 1)).isin(ASSET_EXTENSIONS)


def expand_frontier(seeds: DataFrame, evidence: DataFrame, waves: int = 3) -> DataFrame:
    """Seeds (seed_key) and those they promote, with the wave each came in (0: given).

    ``evidence`` has parent_key, seed_key, source, kind, confidence, reasoned: what collecting for a parent tells of a
    candidate. Evidence adds up over waves, promotion is judged on all of it. The last wave also registers candidates that
    were not promoted, with wave ``waves + 1``. A wave is one stored table, the loop is bounded by ``waves``.
    """
    known = stored(seeds.select("seed_key").distinct().withColumn("wave", F.lit(0)), "wave-0")
    told = None
    for wave in range(1, waves + 1):
        front = known.filter(F.col("wave") == wave - 1)
        if front.isEmpty():
            break
        found = evidence.join(front.select(F.col("seed_key").alias("parent_key")), "parent_key", "left_semi").drop("parent_key")
        told = stored(found if told is None else told.unionByName(found), f"told-{wave}")
        fresh = promote_candidates(told).filter("promoted").select("seed_key").join(known, "seed_key", "left_anti").withColumn("wave", F.lit(wave))
        known = stored(known.unionByName(fresh), f"wave-{wave}")
    if told is None:
        return known
    weak = told.select("seed_key").distinct().join(known, "seed_key", "left_anti").withColumn("wave", F.lit(waves + 1))
    return known.unionByName(weak)


def reach(start: DataFrame, pages: DataFrame, links: DataFrame, most: int, depth: int | None = None, cap_queue: bool = False) -> DataFrame:
    """Pages (seed_id, url, depth, position) reached breadth-first from ``start`` (seed_id, url, pos), at most ``most`` per seed.

    ``pages`` has the urls that were captured, ``links`` seed_id, url, target, pos of links inside the seed's scope. A url
    is queued once, in order of its first link. One that was not captured takes no place; with ``cap_queue`` it does: then at most
    ``most`` urls of a seed are ever queued. Each step adds a page or ends, so there are at most ``most`` steps, ``depth + 1``
    where that is given.
    """
    def capped(fresh: DataFrame, queued: DataFrame | None) -> DataFrame:
        if not cap_queue:
            return fresh
        ranked = fresh.withColumn("n", F.row_number().over(Window.partitionBy("seed_id").orderBy("at", "url"))).filter(F.col("n") <= most)
        held = ranked.withColumn("held", F.lit(0)) if queued is None else ranked.join(queued.groupBy("seed_id").agg(F.count("*").alias("held")), "seed_id", "left")
        return held.filter(F.col("n") + F.coalesce("held", F.lit(0)) <= most).drop("n", "held")

    queued = start.groupBy("seed_id", "url").agg(F.min(F.struct(F.lit(0).alias("parent"), F.col("pos"))).alias("at")).withColumn("depth", F.lit(0))
    queued = stored(capped(queued, None), "queued-0")
    done = None
    for step in range(most if depth is None else min(most, depth + 1)):
        here = queued.filter(F.col("depth") == step).join(pages.select("url").distinct(), "url", "left_semi")
        before = None if done is None else done.groupBy("seed_id").agg(F.count("*").alias("before"))
        here = here.withColumn("n", F.row_number().over(Window.partitionBy("seed_id").orderBy("at", "url")))
        here = here.withColumn("before", F.lit(0)) if before is None else here.join(before, "seed_id", "left")
        here = here.withColumn("position", F.col("n") + F.coalesce("before", F.lit(0))).filter(F.col("position") <= most).select("seed_id", "url", "depth", "position")
        here = stored(here, f"fetched-{step}")
        if here.isEmpty():
            break
        done = here if done is None else done.unionByName(here)
        after = here.join(links, ["seed_id", "url"]).groupBy("seed_id", F.col("target").alias("url")).agg(F.min(F.struct(F.col("position").alias("parent"), F.col("pos"))).alias("at"))
        fresh = after.join(queued, ["seed_id", "url"], "left_anti").withColumn("depth", F.lit(step + 1))
        queued = stored(queued.unionByName(capped(fresh, queued)), f"queued-{step + 1}")
    return done if done is not None else stored(queued.select("seed_id", "url", "depth", F.lit(0).alias("position")).limit(0), "none")


def accepted_roots(outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """Per seed the roots that were collected and are known."""
    rows = outcomes.filter("collect").select("seed_id", "root").distinct().join(known, "root", "left_semi")
    return rows.groupBy("seed_id").agg(F.array_join(F.array_sort(F.collect_list("root")), ",").alias("accepted"))


def reconsider(discarded: DataFrame, facts: DataFrame, accepted: DataFrame, decisions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Discarded candidates with what is known of them now, and those that a new decision (seed_id, root, collect, confidence) promotes."""
    rows = discarded.join(facts.select("root", "assets"), "root", "left").join(accepted, "seed_id", "left").join(decisions, ["seed_id", "root"], "left")
    lines = F.array_compact(F.array(
        F.when(F.col("collectors") != "", F.concat(F.lit("Collectors: "), "collectors")), F.when(F.col("assets").isNotNull(), F.concat(F.lit("Observed assets: "), F.col("assets").cast("string"))),
        F.when(F.col("accepted").isNotNull(), F.concat(F.lit("Accepted roots: "), "accepted"))))
    promoted = F.coalesce(confidence_gate(F.col("collect"), F.col("confidence"), threshold), F.lit(False))
    return rows.select("seed_id", "root", F.array_join(lines, "; ").alias("evidence"), promoted.alias("promoted"), F.when(promoted, "reconsidered").alias("tag"))


def resume_reviews(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue (run_id, root, status) after decisions (root, collect): each row's state, and whether its run still waits."""
    rows = queue.join(decisions.select("root", "collect"), "root", "left")
    state = F.when((F.col("status") != "pending_review"), F.col("status")).when(F.col("collect"), "scheduled").when(~F.col("collect"), "rejected").otherwise("pending_review")
    rows = rows.select("run_id", "root", state.alias("state"))
    waiting = rows.groupBy("run_id").agg(F.bool_or(F.col("state") == "pending_review").alias("blocked"))
    return rows.join(waiting, "run_id")
