"""An analysis outlives its analyzers."""

import pytest
from pyspark.sql import functions as F

from tracewell.plans import analysis, checks, isolation

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    return checks._guarded(spark, SMALL)


def test_broken_analyzers_change_no_verdict(frames):
    broken = {n: a for n, a in checks._own_analyzers().items() if n in (*analysis.DEFAULT_ANALYZERS, "raises", "breaks")}
    verdicts, status = isolation.analyze_guarded(frames, broken)
    plain = analysis.analyze(frames, analysis.DEFAULT_ANALYZERS)
    assert verdicts.exceptAll(plain).isEmpty() and plain.exceptAll(verdicts).isEmpty()
    told = {(r.analyzer_id, r.status) for r in status.select("analyzer_id", "status").distinct().collect()}
    assert {("raises", "failed"), ("breaks", "failed")} < told


def test_refused_findings_are_kept_apart(frames):
    found = isolation.guard(frames, {"careless": checks._own_analyzers()["careless"]})
    assert found.evidence.where("confidence > 1").isEmpty() and not found.refused.isEmpty()
    assert found.refused.where("confidence <= 1").isEmpty()


def test_findings_without_run_and_missing_columns(spark, frames):
    no_run = lambda f: checks._given(f, F.lit(0.5), F.col("k") < 5).withColumn("run_id", F.lit(None).cast("string"))
    found = isolation.guard(frames, {"no_run": no_run, "short": lambda f: f.runs, "none": lambda f: None})
    assert found.evidence.isEmpty() and not found.refused.isEmpty()
    told = {r.analyzer_id: (r.status, r.reason.split(":")[0]) for r in found.status.distinct().dropDuplicates(["analyzer_id"]).collect()}
    assert told["no_run"] == ("ok", "") and told["short"] == ("failed", "AnalysisException") and told["none"] == ("failed", "AttributeError")


def test_no_analyzers(frames):
    found = isolation.guard(frames, {})
    assert found.evidence.isEmpty() and found.status.isEmpty()


def test_status_covers_the_registry(spark):
    steps = spark.createDataFrame([("a", 0, 1, "writer", "x", [])], f"run_id string, pos bigint, step bigint, agent string, raw_output string, tool_calls {checks.activity.TOOL_CALLS}")
    runs = spark.createDataFrame([("a", "x"), ("b", None)], "run_id string, expected_output string")
    found = isolation.guard(analysis.TraceFrames(runs, steps)).status
    by = {(r.run_id, r.analyzer_id): (r.status, r.reason) for r in found.collect()}
    assert {a for _, a in by} == set(analysis.ALL_ANALYZERS)
    assert by["a", "ground_truth"] == ("ok", "") and by["b", "ground_truth"] == ("skipped", "No expected_output present in trace.")
    assert by["a", "counts"] == ("skipped", isolation.NO_COUNTS) and by["b", "workflow"] == ("skipped", "No steps in trace")
