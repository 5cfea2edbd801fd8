"""Capture streams against their batch results, and their edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.sources import store
from tracewell.streaming import capture

DAY = 1_700_006_400  # a midnight; times near the epoch would lie before the first watermark


def as_stream(spark, tmp_path, name, batches, ddl):
    """A stream that delivers one file per batch, in order."""
    folder = tmp_path / name
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(folder / f"part={n}"))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


STEPS = "run_id string, workflow string, step bigint, status string, latency_ms double, tokens_total bigint, at bigint"


def test_runs_over_several_batches_with_repeats(spark, tmp_path):
    batches = [
        [("r", "w", 1, "SUCCESS", 10.0, 5, 0), ("s", "w", 1, "SUCCESS", 1.0, 1, 10)],
        [("r", "w", 2, "FAILURE", 20.0, 5, 60), ("r", "w", 1, "SUCCESS", 10.0, 5, 0)],
        [("r", "w", 3, "ERROR", 30.0, 5, 90000), ("s", "w", 2, "SUCCESS", 1.0, 1, 90)],
    ]
    stream = as_stream(spark, tmp_path, "in", batches, STEPS).withColumn("timestamp", F.timestamp_seconds(F.col("at") + DAY))
    out = str(tmp_path / "out")
    capture.collect_steps(stream, ("run_id", "step"), "step", out, str(tmp_path / "ck")).awaitTermination()
    # a second stream into the same place, with a run that comes 40 days late
    late = as_stream(spark, tmp_path, "late", [[("old", "w", 1, "SUCCESS", 3.0, 4, -40 * 86400)]], STEPS)
    late = late.withColumn("timestamp", F.timestamp_seconds(F.col("at") + DAY))
    capture.collect_steps(late, ("run_id", "step"), "step", out, str(tmp_path / "ck2")).awaitTermination()
    runs = capture.assembled_runs(spark, out, ("run_id", "step"), "step").collect()
    found = {r.run_id: (r.status, r.total_latency_ms, r.total_tokens, r.step_count) for r in runs}
    assert found == {"r": ("ERROR", 60.0, 15, 3), "s": ("SUCCESS", 2.0, 2, 2), "old": ("SUCCESS", 3.0, 4, 1)}


def test_steps_without_token_report_get_zero_after_the_wait(spark, tmp_path):
    ddl = "run_id string, step bigint, at bigint"
    steps = as_stream(spark, tmp_path, "steps", [[("r", 1, 0), ("r", 2, 10)], [("r", 9, 90000)], [("r", 10, 180000)]], ddl)
    tokens = as_stream(
        spark, tmp_path, "tokens", [[("r", 1, 2, 7, 3)], [("r", 9, 90001, 1, 1)], [("r", 10, 180001, 1, 1)]],
        "run_id string, step bigint, at bigint, prompt bigint, completion bigint",
    )
    joined = capture.attach_tokens(
        steps.withColumn("timestamp", F.timestamp_seconds(F.col("at") + DAY)).drop("at"),
        tokens.withColumn("token_time", F.timestamp_seconds(F.col("at") + DAY)).drop("at"),
        ("run_id", "step"), "1 MINUTE", "1 minute",
    )
    out = str(tmp_path / "out")
    capture.append_parquet(joined, out, str(tmp_path / "ck")).awaitTermination()
    found = {r.step: r.tokens_total for r in spark.read.parquet(out).collect()}
    assert found == {1: 10, 2: 0, 9: 2, 10: 2}


def test_step_records_of_failing_agents(spark):
    events = [
        {"run_id": "r", "step": 1, "agent": "writer_node", "output": "text", "tokens_prompt": 3, "tokens_completion": 4, "returned_state": '{"a": 1}'},
        {"run_id": "r", "step": 2, "agent": "verifier", "output": "ignored", "error_type": "ValueError", "error_message": "bad", "returned_state": '{"a": 2}'},
        {"step": 3},
    ]
    raw = spark.createDataFrame([(json.dumps(e),) for e in events] + [("garbage",)], "value string")
    found = {r.step: r for r in capture.parse_step_events(raw).collect()}
    assert set(found) == {1, 2}
    assert capture.unreadable_events(raw).count() == 2
    assert (found[1].agent, found[1].raw_output, found[1].status, found[1].tokens_total) == ("writer", "text", "SUCCESS", 7)
    assert (found[2].raw_output, found[2].status, found[2].error, found[2].returned_state) == ("", "ERROR", "ValueError: bad", None)


def test_upsert_keeps_one_row_per_step(spark, tmp_path):
    ddl = "run_id string, step bigint, agent string, status string, latency_ms double, tokens_total bigint, at bigint"
    batches = [[("r", 1, "a", "SUCCESS", 1.0, 1, 0)], [("r", 1, "a", "ERROR", 2.0, 2, 5), ("r", 2, "b", "SUCCESS", 1.0, 1, 6)]]
    stream = as_stream(spark, tmp_path, "in", batches, ddl).withColumns(
        {"timestamp": F.timestamp_seconds(F.col("at") + DAY), "tokens_prompt": F.lit(0), "tokens_completion": F.lit(0)}
    )
    root = str(tmp_path / "store")
    capture.upsert_steps(stream, root, str(tmp_path / "ck")).awaitTermination()
    found = {r.step: (r.status, r.latency_ms) for r in store.read_table(spark, root, "steps").collect()}
    assert found == {1: ("ERROR", 2.0), 2: ("SUCCESS", 1.0)}
    assert store.read_table(spark, root, "metrics").count() == 10
    # another stream starts at batch 0 again: it neither replaces nor goes before what is stored
    again = as_stream(spark, tmp_path, "more", [[("r", 2, "b", "FAILURE", 3.0, 1, None), ("q", 1, "a", "SUCCESS", 1.0, 1, 9)]], ddl)
    again = again.withColumns(
        {"timestamp": F.timestamp_seconds(F.col("at") + DAY), "tokens_prompt": F.lit(0), "tokens_completion": F.lit(0)}
    )
    capture.upsert_steps(again, root, str(tmp_path / "ck2")).awaitTermination()
    found = {(r.run_id, r.step): (r.status, r.latency_ms) for r in store.read_table(spark, root, "steps").collect()}
    assert found == {("r", 1): ("ERROR", 2.0), ("r", 2): ("FAILURE", 3.0), ("q", 1): ("SUCCESS", 1.0)}


@pytest.mark.parametrize("base, flags", [(None, [(2, True, False)]), ((True, 100.0, 50.0), [(1, False, True), (2, True, True)]), ((False, 1.0, 1.0), [(2, True, False)])])
def test_live_flags(spark, base, flags):
    steps = spark.createDataFrame([(0, 200.0), (1, 300.0), (2, 6000.0)], "step int, latency_ms double")
    snapshot = None
    if base:
        snapshot = spark.createDataFrame([base], "active boolean, latency_mean double, latency_std double").first()
    found = capture.live_flags(steps, snapshot).orderBy("step").collect()
    assert [(r.step, r.latency_flag, r.statistical_flag) for r in found] == flags
