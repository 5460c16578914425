"""A stream of reviews and decisions over restarts."""

from datetime import datetime, timedelta

from latticework.streaming.reviews import review_states

REVIEW, DECISION = "run_id string, root string, status string, at timestamp", "run_id string, root string, collect boolean, at timestamp"


def _at(day, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=day, hours=hour)


def test_decisions_before_after_and_without_their_review(spark, tmp_path):
    def run(reviews, decisions):
        spark.createDataFrame(reviews, REVIEW).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        spark.createDataFrame(decisions, DECISION).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
        streams = [spark.readStream.schema(s).parquet(str(tmp_path / p)) for s, p in ((REVIEW, "r"), (DECISION, "d"))]
        rows = review_states(spark, *streams, str(tmp_path / "out"), str(tmp_path / "progress"), timedelta(days=3))
        return {(r.run_id, r.root): (r.state, r.blocked) for r in rows.collect()}

    first = run([("a", "late.com", "pending_review", _at(1)), ("a", "auto.com", "auto_rejected", _at(1)), ("b", "open.com", "pending_review", _at(1)), ("b", "open.com", "auto_rejected", _at(1, 5))],
                [("c", "early.com", True, _at(1)), ("c", "twice.com", True, _at(1)), ("c", "twice.com", False, _at(1, 1))])
    assert first == {("a", "late.com"): ("pending_review", True), ("a", "auto.com"): ("auto_rejected", True), ("b", "open.com"): ("pending_review", True)}
    second = run([("c", "early.com", "pending_review", _at(2)), ("c", "twice.com", "pending_review", _at(2))], [("a", "late.com", False, _at(2))])
    assert second == {("a", "late.com"): ("rejected", False), ("a", "auto.com"): ("auto_rejected", False), ("b", "open.com"): ("pending_review", True), ("c", "early.com"): ("scheduled", False), ("c", "twice.com"): ("rejected", False)}
    third = run([("x", "x.com", "auto_rejected", _at(9))], [("x", "y.com", True, _at(9))])
    assert third[("b", "open.com")] == ("overdue", True) and third[("a", "late.com")] == ("rejected", False) and third[("x", "x.com")] == ("auto_rejected", False)
    fourth = run([], [("b", "open.com", True, _at(9, 1))])
    assert fourth[("b", "open.com")] == ("scheduled", False) and len(fourth) == 6
