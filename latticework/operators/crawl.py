"""Captured pages reached from each seed, with redirects followed first, and what reaching them tells: hosts, and roots outside the scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.frontier import followable, reach
from latticework.session import stored

#: Redirects that a fetch follows at most.
HOPS = 10


def contract_redirects(redirects: DataFrame, most: int = HOPS) -> DataFrame:
    """Each redirecting url with where its chain ends: (url, final_url, hops, error).

    ``redirects`` (url, target): one row for each url that redirects; of several the smallest target counts. Chains are contracted by pointer jumping: every
    round doubles what a pointer skips, so the number of rounds is that of ``most``'s binary digits, whatever the chains' lengths. A chain that has not ended after
    ``most`` hops, such as any cycle, has no final url but an error.
    """
    one = redirects.groupBy("url").agg(F.min("target").alias("target"))
    jump = stored(one.select("url", F.col("target").alias("to"), F.lit(1).cast("bigint").alias("hops")), "jumps")
    span = 1
    while span <= most:
        step = jump.select(F.col("url").alias("to"), F.col("to").alias("further"), F.col("hops").alias("more"))
        jump = stored(jump.join(step, "to", "left").select("url", F.coalesce("further", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "jumps")
        span *= 2
    # what is still on a redirecting url after more than ``most`` hops is in a cycle or on a long chain
    open_ = jump.join(one.select(F.col("url").alias("to"), F.lit(True).alias("open")), "to", "left")
    bad = F.coalesce("open", F.lit(False)) | (F.col("hops") > most)
    return open_.select("url", F.when(~bad, F.col("to")).alias("final_url"), F.when(~bad, F.col("hops")).alias("hops"), F.when(bad, F.lit(f"stopped after {most} redirects")).alias("error"))


def fetched_pages(answers: DataFrame, hops: int = HOPS) -> DataFrame:
    """Urls whose fetch ends at a captured page: (url, final_url). ``answers`` (url, target, page): target where the answer redirects, else null; page: whether it is
    a page that can be read."""
    ends = contract_redirects(answers.filter("target is not null").select("url", "target"), hops).filter("error is null")
    pages = answers.filter("target is null and page").select("url").distinct()
    moved = ends.join(pages.select(F.col("url").alias("final_url")), "final_url", "left_semi").select("url", "final_url")
    return pages.select("url", F.col("url").alias("final_url")).union(moved)


def crawl(start: DataFrame, scope: DataFrame, fetched: DataFrame, hosts: DataFrame, links: DataFrame, most: int = 12, depth: int = 2) -> dict[str, DataFrame]:
    """Breadth-first search from ``start`` (seed_id, url, pos) inside each seed's ``scope`` (seed_id, root): at most ``most`` pages of a seed, ``depth`` links deep.

    ``fetched``: (url, final_url); ``hosts`` (url, host, root) of all final urls and link targets; ``links`` (url, target, pos, relation) of final pages.
    A page that ends outside the scope takes a place but its links don't count. Results: pages (seed_id, url, final_url, depth, position); hosts (seed_id, host): hosts below a root
    of the scope that a page ends at or links to; candidates (seed_id, root, source_url, target_url, relation): links out of the scope, and redirects out
    of it with relation ``redirect``.
    """
    at = fetched.join(hosts.select(F.col("url").alias("final_url"), F.col("host").alias("final_host"), F.col("root").alias("final_root")), "final_url")
    # links get their hosts once and are then read for the steps, the hosts and the candidates
    led = stored(links.join(hosts.select(F.col("url").alias("target"), F.col("host").alias("target_host"), F.col("root").alias("target_root")), "target").filter("target_root <> ''"), "led")
    inside = led.join(scope.select("seed_id", F.col("root").alias("target_root")), "target_root")
    # a seed's own links: from its pages, by where their fetch ends, to what is in its scope
    own = at.join(scope.select("seed_id", F.col("root").alias("final_root")), "final_root").select("seed_id", F.col("url").alias("asked"), F.col("final_url").alias("url"))
    followed = stored(own.join(inside.filter(followable(F.col("target"))), ["seed_id", "url"]).select("seed_id", F.col("asked").alias("url"), "target", "pos"), "followed")
    reached = reach(start, fetched.select("url"), followed, most, depth)
    pages = stored(reached.join(at, "url").select("seed_id", "url", "final_url", "final_host", "final_root", "depth", "position"), "pages")
    known = scope.select("seed_id", F.col("root").alias("final_root"))
    within = stored(pages.join(known, ["seed_id", "final_root"], "left_semi"), "within")
    on = within.select("seed_id", F.col("final_url").alias("url")).distinct()
    ended = within.filter("final_host <> final_root").select("seed_id", F.col("final_host").alias("host"))
    told = on.join(inside, ["seed_id", "url"]).filter("target_host <> target_root").select("seed_id", F.col("target_host").alias("host"))
    out = on.join(led, "url").join(scope.select("seed_id", F.col("root").alias("target_root")), ["seed_id", "target_root"], "left_anti")
    out = out.select("seed_id", F.col("target_root").alias("root"), F.col("url").alias("source_url"), F.col("target").alias("target_url"), "relation")
    away = pages.join(known, ["seed_id", "final_root"], "left_anti").select("seed_id", F.col("final_root").alias("root"), F.col("url").alias("source_url"), F.col("final_url").alias("target_url"), F.lit("redirect").alias("relation"))
    return {"pages": pages.select("seed_id", "url", "final_url", "depth", "position"), "hosts": ended.union(told).distinct(), "candidates": out.union(away)}
