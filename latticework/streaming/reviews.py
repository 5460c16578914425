"""Reviews that wait for decisions, as a stream of both: a decision may come before its review, after it, or never."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from latticework.streaming.live_fold import PROVIDER

STATE = "run_id string, root string, state string, opened_us bigint"


class ReviewState(StatefulProcessor):
    """One review of a run: when it was opened and how, and the latest decision. A timer marks one that stays open too long."""

    def __init__(self, patience_s: int) -> None:
        self.patience_ms = patience_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("review", "opened_us bigint, status string, decided_us bigint, collect boolean, overdue boolean")

    def row(self, key, kept) -> Iterator[Row]:
        opened, status, decided, collect, overdue = kept
        if opened is None:
            return  # a decision without a review waits silently
        state = status
        if status == "pending_review":
            state = ("scheduled" if collect else "rejected") if decided is not None else "overdue" if overdue else status
        yield Row(run_id=key[0], root=key[1], state=state, opened_us=opened)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        opened, status, decided, collect, overdue = self.kept.get() if self.kept.exists() else (None, None, None, None, False)
        for r in rows:
            if r.status is not None and (opened is None or r.at_us < opened):  # what a review is, its first row settles
                opened, status = r.at_us, r.status
            if r.collect is not None and (decided is None or (r.at_us, r.collect) > (decided, collect)):  # the last decision counts
                decided, collect = r.at_us, r.collect
        kept = (opened, status, decided, collect, overdue)
        self.kept.update(kept)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status == "pending_review" and decided is None and not overdue:
            self.handle.registerTimer(max(opened // 1000 + self.patience_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield from self.row(key, kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        opened, status, decided, collect, _ = self.kept.get()
        if decided is None:
            kept = (opened, status, decided, collect, True)
            self.kept.update(kept)
            yield from self.row(key, kept)

    def close(self) -> None:
        pass


def review_states(spark: SparkSession, reviews: DataFrame, decisions: DataFrame, target: str, checkpoint: str, patience: timedelta = timedelta(days=7), late: str = "0 seconds") -> DataFrame:
    """Each review's state (run_id, root, state, opened_us), and whether its run waits: a run is blocked while one of its reviews is pending or overdue.

    ``reviews`` (run_id, root, status, at) and ``decisions`` (run_id, root, collect, at) are streams; ``at`` is a timestamp, on both sides with a watermark that
    waits for rows ``late``. Only reviews that are pending wait; of several rows of a review the first one counts, of several
    decisions the last, equal times in favour of collecting. A pending review without a decision is overdue once the watermark has passed its opening by ``patience``; a
    decision settles it even then. Each micro-batch writes the reviews it touched; one that runs again replaces its own rows.
    """
    us = F.unix_micros("at").alias("at_us")
    asked = reviews.withWatermark("at", late).select("run_id", "root", "at", us, "status", F.lit(None).cast("boolean").alias("collect"))
    told = decisions.withWatermark("at", late).select("run_id", "root", "at", us, F.lit(None).cast("string").alias("status"), "collect")
    states = asked.unionByName(told).groupBy("run_id", "root").transformWithState(ReviewState(int(patience.total_seconds())), STATE, "Update", "EventTime")

    def write(rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/version={version}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    every = spark.read.schema(f"{STATE}, version bigint").parquet(target)
    # a timer fires after the rows of its batch, and says more: within a version the settled or overdue state counts
    latest = every.groupBy("run_id", "root").agg(F.max_by(F.struct("state", "opened_us"), F.struct("version", F.col("state") != "pending_review")).alias("x")).select("run_id", "root", "x.*")
    runs = latest.groupBy("run_id").agg(F.bool_or(F.col("state").isin("pending_review", "overdue")).alias("blocked"))
    return latest.join(runs, "run_id")
