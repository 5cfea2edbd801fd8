"""Positions, chunks and plans when one run holds most of the rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import explore, metrics, normalize, ranking
from tracewell.plans.catalog import QUERIES
from tracewell.sources import activity, store, traces

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark):
    """3000 steps, two thirds of them in one run, in random order."""
    rng = random.Random(7)
    rows = [
        ("hot" if n % 3 else f"cold{n % 30}", rng.randrange(500), n, rng.choice("abc"), float(rng.randrange(9000)), rng.randrange(90))
        for n in range(3000)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "run_id string, t int, event_id bigint, agent string, latency_ms double, tokens_total bigint")


@pytest.fixture(scope="module")
def ranked(hot):
    return ranking.dense_position(hot, ["run_id"], ["t", "event_id"]).cache()


def test_positions_are_the_exact_row_numbers(hot, ranked):
    expected = hot.toPandas().sort_values(["run_id", "t", "event_id"])
    expected["pos"] = expected.groupby("run_id").cumcount()
    found = ranked.toPandas().sort_values(["run_id", "t", "event_id"])
    assert found["pos"].tolist() == expected["pos"].tolist()
    assert list(ranked.columns) == [*hot.columns, "pos"]


def test_crowded_times_are_numbered_exactly(spark):
    """A run whose rows share few minutes, and mostly one single time."""
    rng = random.Random(11)
    rows = [
        (n * 400_000, "hot" if n % 4 else "cold", 0 if n % 3 else rng.randrange(90), rng.randrange(3)) for n in range(900)
    ]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "event_id bigint, run_id string, s int, us int").withColumn(
        "timestamp", F.timestamp_micros((F.col("s") + 1_700_000_000).cast("bigint") * 1_000_000 + F.col("us"))
    )
    found = activity.with_positions(events).toPandas().sort_values(["run_id", "timestamp", "event_id"])
    assert len(found) == 900
    assert found["pos"].tolist() == found.groupby("run_id").cumcount().tolist()


def test_one_run_within_one_minute_spreads_over_tasks(spark):
    """Most rows in one run, within one minute, at distinct microseconds."""
    events = spark.range(4000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("run_id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 7919 % 59_000_000).alias("timestamp"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = activity.with_positions(events).where("run_id = 'hot'").withColumn("task", F.spark_partition_id()).toPandas()
        assert found["task"].nunique() > 1
        assert found.sort_values(["timestamp", "event_id"])["pos"].tolist() == list(range(3600))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_steps_without_a_time_come_first(spark):
    rows = [(1, "r", "2024-01-01 00:00:00"), (3, "r", None), (2, "r", None)]
    events = spark.createDataFrame(rows, "event_id bigint, run_id string, t string").withColumn("timestamp", F.col("t").cast("timestamp"))
    found = activity.with_positions(events).orderBy("pos").collect()
    assert [(r.pos, r.event_id) for r in found] == [(0, 2), (1, 3), (2, 1)]


def test_values_reach_every_step_of_a_long_run(ranked):
    found = metrics.step_share(ranked, chunk=64).toPandas()
    assert len(found) == 3000
    plain = ranked.toPandas()
    top = plain.groupby("run_id")["latency_ms"].max()
    for run_id, group in found.groupby("run_id"):
        assert set(group["max_latency_ms"]) == {top[run_id]}
        assert set(group["run_steps"]) == {int((plain["run_id"] == run_id).sum())}


def test_timeline_takes_the_last_state_of_the_agent(ranked):
    found = explore.timeline(ranked, ranked, F.col("event_id"), chunk=64).toPandas()
    plain = ranked.toPandas().sort_values("pos").groupby(["run_id", "agent"]).tail(1).set_index(["run_id", "agent"])["event_id"]
    assert len(found) == 3000
    assert all(plain[(r.run_id, r.agent)] == r.agent_state for r in found.itertuples())


def test_long_runs_become_several_documents_and_back(spark, ranked, tmp_path):
    steps = ranked.select("run_id", "pos", (F.col("pos") + 1).cast("int").alias("step"), "agent", "latency_ms")
    runs = steps.select("run_id", F.lit("w").alias("workflow")).distinct().union(
        spark.createDataFrame([("empty", "w")], "run_id string, workflow string")
    )
    docs = traces.nest_documents(runs, steps, ["step", "agent", "latency_ms"], chunk=100)
    assert docs.where("run_id = 'hot'").count() == 20
    assert docs.agg(F.max(F.size("steps"))).first()[0] == 100
    traces.write_traces(docs, str(tmp_path / "docs"))
    again = traces.scan_traces(spark, str(tmp_path / "docs"), one_per_file=False)
    assert normalize.normalize_runs(again).count() == runs.count()
    back = normalize.normalize_steps(again).select("run_id", "pos", "step", "agent", "latency_ms")
    wanted = steps.select("run_id", "pos", F.col("step").cast("bigint").alias("step"), "agent", "latency_ms")
    assert back.exceptAll(wanted).isEmpty() and wanted.exceptAll(back).isEmpty()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_shuffles_no_single_steps(spark):
    """Steps are condensed before they are shuffled, without positions or windows."""
    text = plan(QUERIES["verdicts"](spark, SMALL))
    assert "Window" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "HashAggregate(keys=[run_id" in text and "Python" not in text
    for line in text.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "hashpartitioning(run_id" in line


@pytest.mark.parametrize("name", ["step_metrics", "step_anomalies", "step_share", "ordered_evidence", "tool_rules"])
def test_ranking_windows_are_split_below_the_run(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for line in text.splitlines():
        if "row_number()" in line:
            assert "_part" in line
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(QUERIES["runs_rollup"](spark, SMALL))
    assert "event_id" in text
    narrow = plan(activity.event_steps(spark, SMALL).groupBy("run_id").agg(F.min("timestamp")))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in narrow


def test_latest_keeps_unmatched_rows(spark):
    old = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "run_id string, step bigint, agent string")
    new = spark.createDataFrame([("r", 2, "c"), ("s", 1, "d")], "run_id string, step bigint, agent string")
    found = {tuple(r) for r in store.upsert(old, new, ("run_id", "step")).collect()}
    assert found == {("r", 1, "a"), ("r", 2, "c"), ("s", 1, "d")}
    wider = new.withColumn("note", F.lit("n"))
    assert store.upsert(old, wider, ("run_id", "step")).where("note IS NULL").count() == 1


def test_latest_without_an_order_keeps_the_values(spark):
    rows = spark.createDataFrame([("r", 1, "a", None), ("s", 1, "b", None), ("s", 1, "c", 2)], "run_id string, step bigint, agent string, seq bigint")
    assert {tuple(r) for r in store.latest(rows, ("run_id", "step"), ("seq",)).collect()} == {("r", 1, "a"), ("s", 1, "c")}


def test_unreadable_documents_are_told_apart(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"run_id": "r", "steps": []}')
    (tmp_path / "bad.json").write_text("{broken")
    (tmp_path / "other.json").write_text('{"id": 1}')
    assert [r.run_id for r in traces.scan_traces(spark, str(tmp_path)).collect()] == ["r"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in traces.unreadable_traces(spark, str(tmp_path)).collect()) == ["bad.json", "other.json"]
    rows = spark.createDataFrame([('{"run_id": "r"}',), ("x",), (None,)], "trace_json string")
    assert traces.parse_traces(rows).count() == 1 and traces.unparsed(rows).count() == 2


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    steps = spark.createDataFrame(
        [("r1", 1, "a", 5.0, 1, 2, 3), ("r1", 2, "b", 7.0, 0, 0, 0)],
        "run_id string, step bigint, agent string, latency_ms double, tokens_prompt bigint, tokens_completion bigint, tokens_total bigint",
    )
    runs = spark.createDataFrame([("r1", "w", "SUCCESS"), ("r_2", "w", "ERROR")], "run_id string, workflow string, status string")
    store.write_runs(runs, steps, root, 0)
    store.write_runs(runs.limit(0), steps.where("step = 2").withColumn("latency_ms", F.lit(9.0)), root, 1)
    store.write_runs(runs.limit(0), steps.where("step = 2").withColumn("latency_ms", F.lit(9.0)), root, 1)  # a retry
    evidence = spark.createDataFrame([("r1", 0.5)], "run_id string, confidence double")
    store.write_batch(evidence, root, "analysis", 0)
    store.write_batch(evidence, root, "analysis", 1)
    tables = {t: store.read_table(spark, root, t) for t in store.TABLES}
    assert {r.table_name: r.n_rows for r in store.table_counts(tables).collect()} == {
        "runs": 2, "steps": 2, "metrics": 10, "analysis": 2
    }
    assert {r.step: r.latency_ms for r in tables["steps"].collect()} == {1: 5.0, 2: 9.0}
    one = metrics.metrics_for_run(tables["metrics"], "r1").collect()
    assert [(r.step, r.metric_name) for r in one[:2]] == [(1, "execution_time_ms"), (1, "latency_ms")]
    assert one[5].metric_value == 9.0 and one[5].metric_unit == "ms"
    assert store.count_like(tables["runs"], "r_%").first().n_rows == 2
    new_root = str(tmp_path / "compact")
    store.copy_current(spark, root, new_root)
    assert store.read_table(spark, new_root, "steps").exceptAll(tables["steps"]).isEmpty()


# -------------------------------------------------------------------- metrics


def step_rows(spark, latencies, tokens=None):
    rows = [
        (f"r{i // 3}", i % 3, i % 3 + 1, "abc"[i % 3], "w", float(x), (tokens or [100] * len(latencies))[i], 0)
        for i, x in enumerate(latencies)
    ]
    ddl = "run_id string, pos bigint, step bigint, agent string, workflow string, latency_ms double, tokens_total bigint, tokens_prompt bigint"
    return spark.createDataFrame(rows, ddl).withColumns(
        {"tokens_completion": F.col("tokens_total"), "timestamp": F.timestamp_seconds(F.substring("run_id", 2, 9).cast("int")), "status": F.lit("SUCCESS")}
    )


def test_threshold_is_strict(spark):
    steps = step_rows(spark, [5000, 5001, 100])
    found = metrics.step_metrics(steps).orderBy("step").collect()
    assert [r.latency_flag for r in found] == [False, True, False]
    assert found[1].anomaly_reasons == ["latency 5001ms > threshold 5000ms"]


def test_baseline_needs_five_runs(spark):
    few, many = step_rows(spark, [100.0] * 12), step_rows(spark, [100.0, 110.0, 90.0] * 6 + [100.0, 100.0, 9000.0], [100] * 20 + [9000])
    runs = [s.select("run_id", "timestamp").distinct() for s in (few, many)]
    assert not metrics.baseline(few, runs[0]).first().active
    base = metrics.baseline(many, runs[1])
    values = pd.Series([100.0, 110.0, 90.0] * 6 + [100.0, 100.0, 9000.0])
    row = base.first()
    assert row.active and row.latency_mean == pytest.approx(values.mean()) and row.latency_std == pytest.approx(values.std())
    odd = metrics.step_metrics(many, base).where("is_anomalous").collect()
    assert [(r.run_id, r.step) for r in odd] == [("r6", 3)]
    assert [x.split(" ")[0] for x in odd[0].anomaly_reasons] == ["latency", "latency", "tokens"]
    assert odd[0].anomaly_reasons[1].endswith("+ 2.5σ)")


def test_run_metrics_ties_and_empty_runs(spark):
    steps = step_rows(spark, [7, 3, 7, 3, 3, 3])
    runs = spark.createDataFrame([("r0", "w"), ("r1", "w"), ("none", "w")], "run_id string, workflow string")
    found = {r.run_id: r for r in metrics.run_metrics(runs, metrics.step_metrics(steps)).collect()}
    assert (found["r0"].slowest_step, found["r0"].fastest_step) == ("a", "b")
    assert (found["r1"].slowest_step, found["r1"].fastest_step) == ("a", "a")
    assert (found["none"].step_count, found["none"].total_latency_ms, found["none"].slowest_step) == (0, 0.0, None)


def test_last_failure_wins(spark):
    rows = [("r", 0, "ERROR"), ("r", 1, "FAILURE"), ("r", 2, "SUCCESS"), ("s", 0, "SKIPPED")]
    steps = spark.createDataFrame(rows, "run_id string, pos bigint, status string").withColumns(
        {"workflow": F.lit("w"), "timestamp": F.current_timestamp(), "latency_ms": F.lit(1.0), "tokens_total": F.lit(1)}
    )
    assert {r.run_id: r.status for r in metrics.roll_up(steps).collect()} == {"r": "FAILURE", "s": "SUCCESS"}


def test_newest_runs_break_ties_by_id(spark):
    runs = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9)], "run_id string, timestamp int")
    assert [r.run_id for r in metrics.newest_runs(runs, 2).collect()] == ["c", "a"]
