"""Recorded decisions on candidates: summaries, gates, promotion and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["collector", "seed_id", "scenario"]


def confidence_gate(collect: Column, confidence: Column, threshold: float = 0.5) -> Column:
    return collect & (confidence >= min(1.0, max(0.0, threshold)))


def merged_outcomes(outcomes: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """One outcome per group and root: collected if ever, highest confidence, kind of the last that collected, else the first."""
    return _merged(outcomes, by, ["kind"])


def _merged(outcomes: DataFrame, by: list[str], texts: list[str]) -> DataFrame:
    """One outcome per group and root, with each of ``texts`` of the last that collected and told it, else the first that told it.

    Outcomes that tell the same are first folded to numbers, which map tasks do without sorting their rows; texts are chosen among what is left.
    """
    told = outcomes.groupBy(*by, "root", "collect", *texts).agg(F.max("confidence").alias("confidence"), F.bool_or("explicit").alias("explicit"), F.min("eval_seq").alias("first_"), F.max("eval_seq").alias("last_"))
    chosen = lambda t: F.coalesce(F.max_by(t, F.when(F.col("collect") & (F.col(t) != ""), F.col("last_"))), F.min_by(t, F.when(F.col(t) != "", F.col("first_")))).alias(t)
    return told.groupBy(*by, "root").agg(F.bool_or("collect").alias("collect"), F.max("confidence").alias("confidence"), F.bool_or("explicit").alias("explicit"), *map(chosen, texts))


def first_spellings(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Distinct values of each group, whatever their case: (by, spelled, at), spelled as they came first; blank ones don't count."""
    told = rows.withColumn("spelled", F.trim(value)).filter("spelled <> ''")
    told = told.groupBy(*by, "spelled").agg(F.min(order).alias("at"))  # each spelling once, before any is chosen
    return told.groupBy(*by, F.lower("spelled").alias("low")).agg(F.min_by("spelled", F.struct("at", "spelled")).alias("spelled"), F.min("at").alias("at")).drop("low")


def judged_candidates(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """One row per group and root: as ``merged_outcomes``, with the reason (of the last that collected and gave one, else the first given) and the
    support of all its outcomes, sorted. ``outcomes`` has reason and support (an array) too."""
    whole = [*by, "root"]
    told = outcomes.filter("root <> ''")
    support = first_spellings(told.select(*whole, "eval_seq", F.explode("support").alias("s")), whole, "s", "eval_seq").groupBy(*whole).agg(F.array_join(F.array_sort(F.collect_list("spelled")), ", ").alias("support"))
    rows = _merged(told, by, ["kind", "reason"]).join(support, whole, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("reason", "support")})


def discarded_details(outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """``discarded_candidates`` with the distinct reasons and support of their outcomes, in the order in which they came."""
    by = ["seed_id", "root"]
    kept = discarded_candidates(outcomes, known)
    mine = outcomes.filter("not collect").join(kept.select(*by), by, "left_semi")
    def joined(rows: DataFrame, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("at", "spelled")))
        return first_spellings(rows, by, "v", "at_").groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["spelled"]), "; ").alias(name))

    reasons = joined(mine.select(*by, F.struct("eval_seq", F.lit(0).alias("pos")).alias("at_"), F.col("reason").alias("v")), "reasons")
    support = joined(mine.select(*by, "eval_seq", F.posexplode("support").alias("pos", "v")).select(*by, F.struct("eval_seq", "pos").alias("at_"), "v"), "support")
    rows = kept.join(reasons, by, "left").join(support, by, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("reasons", "support")})


def judge_summary(outcomes: DataFrame) -> DataFrame:
    """Per collector, seed and scenario the accepted and discarded roots, sorted."""
    roots = lambda keep: F.array_join(F.array_sort(F.collect_list(F.when(keep, F.col("root")))), ",")
    return merged_outcomes(outcomes).groupBy(*GROUP).agg(
        F.count_if("collect").alias("n_accepted"), F.count_if(~F.col("collect")).alias("n_discarded"), roots(F.col("collect")).alias("accepted"), roots(~F.col("collect")).alias("discarded"), F.max("confidence").alias("top_confidence"),
    )


def roots_for_seed(outcomes: DataFrame) -> DataFrame:
    """Per seed the sets of roots accepted and discarded; a root can be in both."""
    s = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("root")))), ",")
    return outcomes.groupBy("seed_id").agg(s(F.col("collect")).alias("accepted"), s(~F.col("collect")).alias("discarded"))


def discarded_candidates(outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """Per seed and root never collected and not known: collectors, scenarios, explicit and implicit counts."""
    taken = outcomes.filter("collect").select("seed_id", "root").distinct()
    left = outcomes.filter("not collect").join(taken, ["seed_id", "root"], "left_anti").join(known, "root", "left_anti")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return left.groupBy("seed_id", "root").agg(names("collector").alias("collectors"), names("scenario").alias("scenarios"), F.count_if("explicit").alias("explicit"), F.count_if(~F.col("explicit")).alias("implicit"))


def promote_candidates(evidence: DataFrame, seeds: DataFrame | None = None, sure: float = 0.9, signals: int = 2) -> DataFrame:
    """Per key whether it is promoted: reasoned, or confident enough, or supported by enough distinct (source, kind).

    ``seeds`` (seed_key, confidence, evidence: array of source, kind, confidence, reasoned), if given, are the candidates' own rows: their
    confidence and what they came with count too.
    """
    told = (F.col("source") != "") & (F.col("kind") != "")
    rows = evidence.select("seed_key", "source", "kind", "confidence", "reasoned", F.lit(None).cast("double").alias("own"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select("seed_key", F.lit("").alias("source"), F.lit("").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("reasoned"), F.col("confidence").alias("own")))
        rows = rows.unionByName(seeds.select("seed_key", F.inline("evidence")).select("seed_key", "source", "kind", "confidence", "reasoned", F.lit(None).cast("double").alias("own")))
    agg = rows.groupBy("seed_key").agg(F.bool_or("reasoned").alias("reasoned"), F.max(F.coalesce("own", F.when(told, F.col("confidence")))).alias("confidence"), F.count_distinct(F.when(told, F.struct("source", "kind"))).alias("signals"))
    return agg.withColumn("promoted", F.col("reasoned") | (F.coalesce("confidence", F.lit(0.0)) >= sure) | (F.col("signals") >= signals))


def review_queue(outcomes: DataFrame, manual: bool = True, pending_below: float = 0.8) -> DataFrame:
    """One row per root that was ever turned down: status and first sight from the row that opened it, the rest from the last."""
    opened = F.when(~F.col("collect"), F.col("eval_seq"))
    status = F.when(F.lit(manual) & (F.col("confidence") < pending_below), "pending_review").otherwise("auto_rejected")
    return outcomes.groupBy("root").agg(F.min(opened).alias("opened_seq"), F.min_by(status, opened).alias("status"), F.min_by("collector", opened).alias("opened_by"), F.max_by("collector", "eval_seq").alias("last_collector"), F.max_by("confidence", "eval_seq").alias("last_confidence")).filter("opened_seq is not null")


def decisions_to_outcomes(candidates: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Every candidate has an outcome: without a decision it is not collected, and not explicit."""
    return candidates.join(decisions, key, "left").select(key, F.coalesce("collect", F.lit(False)).alias("collect"), F.col("collect").isNotNull().alias("explicit"))


def merge_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence of a seed with equal source, kind and value becomes one, in first-seen order (``position``); rows without any of these go."""
    by = ["seed_key", "source", "kind", "value"]
    one = evidence.filter("not (source = '' and kind = '' and value = '')").groupBy(*by).agg(F.max("confidence").alias("confidence"), F.bool_or("reasoned").alias("reasoned"), F.min("seq").alias("at"))
    return one.withColumn("position", F.row_number().over(Window.partitionBy("seed_key").orderBy("at"))).drop("at")


def promotion_gate(candidates: DataFrame, decisions: DataFrame, manual: bool = True) -> DataFrame:
    """Candidates (root) with what a prior review (root, collect) says of them; without one they wait if ``manual``."""
    gate = F.when(F.col("collect"), "accepted").when(~F.col("collect"), "rejected").otherwise("pending" if manual else "accepted")
    return candidates.join(decisions, "root", "left").withColumn("decision", gate).drop("collect")
