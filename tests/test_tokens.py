"""Token reports meet their steps once, late or early."""

import glob
from datetime import datetime, timedelta

import pytest

from tracewell import schema
from tracewell.plans import stored
from tracewell.streaming import tokens

NOON = datetime(2024, 5, 1, 12)
SCHEMA = "kind string, run_id string, step bigint, agent string, timestamp timestamp, tokens_prompt bigint, tokens_completion bigint"


def step(n, minute, run="r"):
    return ("step", run, n, "a", NOON + timedelta(minutes=minute), None, None)


def report(n, minute, prompt, completion, run="r"):
    return ("report", run, n, None, NOON + timedelta(minutes=minute), prompt, completion)


def test_reports_in_any_order(spark, tmp_path):
    root = str(tmp_path / "store")

    def arrive(i, rows):
        tokens.attach_batch(spark.createDataFrame(rows, SCHEMA), root, "s", i, "10 MINUTES")

    def known():
        return {(r.run_id, r.step): (r.tokens_prompt, r.tokens_completion, r.tokens_total) for r in tokens.attached_steps(spark, root).collect()}

    # 1 with its report, 2 before its report, a report before its step 3
    arrive(0, [step(1, 0), report(1, 1, 5, 6), step(2, 0), report(3, 1, 7, None)])
    assert known() == {("r", 1): (5, 6, 11), ("r", 2): (0, 0, 0)}
    waits = {(r.kind, r.step) for r in tokens.waiting(spark, root).collect()}
    assert waits == {("step", 2), ("report", 3), ("clock", None)}
    later = [report(2, 2, 1, 2), step(3, 2), step(4, 3), report(5, 3, 9, 9)]
    arrive(1, later)
    arrive(1, later)  # a retry
    assert known() == {("r", 1): (5, 6, 11), ("r", 2): (1, 2, 3), ("r", 3): (7, 0, 7), ("r", 4): (0, 0, 0)}
    # much later: 4 is given up, the report of 5 put aside; 1 is reported once more
    arrive(2, [step(6, 60), report(1, 60, 50, 60)])
    assert {(r.kind, r.step) for r in tokens.waiting(spark, root).collect()} == {("step", 6), ("clock", None)}
    assert known()["r", 1] == (50, 60, 110) and known()["r", 4] == (0, 0, 0)
    # the report of 4 and the step of 5 come after all; 2 is repeated and keeps its tokens
    arrive(3, [report(4, 61, 3, 4), step(5, 3), step(2, 100)])
    assert known() == {
        ("r", 1): (50, 60, 110), ("r", 2): (1, 2, 3), ("r", 3): (7, 0, 7), ("r", 4): (3, 4, 7), ("r", 5): (9, 9, 18), ("r", 6): (0, 0, 0),
    }


def test_nothing_arrives(spark, tmp_path):
    root = str(tmp_path / "store")
    tokens.attach_batch(spark.createDataFrame([], SCHEMA), root, "s", 0, "1 MINUTE")
    assert tokens.attached_steps(spark, root).isEmpty() and [c for c, _ in schema.STEP_COLUMNS] == tokens.attached_steps(spark, root).columns


@pytest.mark.parametrize("query, files", [("pending_tokens", "token-files"), ("incremental_runs", "step-files")])
def test_several_tasks_write_the_files_of_a_batch(spark, tmp_path, monkeypatch, query, files):
    events = spark.range(400).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-05-01 12:00:00' AS ts", "id % 5 AS user_id", "'view' AS event_type", "1.0D AS value",
        """concat('{"k": ', id % 100, '}') AS props""",
    )
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(stored, "work_dir", lambda spark, name: str(tmp_path / name))
    found = getattr(stored, query)(spark, str(tmp_path))
    assert found.count() == (400 if query == "pending_tokens" else 5)
    assert len(glob.glob(f"{tmp_path}/progress/commits/[0-9]")) == 5
    assert len(glob.glob(f"{tmp_path}/{files}/part-*")) > 5
