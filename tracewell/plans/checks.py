"""Queries over the checks of execution, handoffs and verification, and over embedded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions import values
from tracewell.operators import checks, diff, metrics
from tracewell.operators.arbiter import resolve
from tracewell.plans import analysis, isolation
from tracewell.sources import activity

CONTRACTS = {"user": ("extra", "mark"), "assistant": ("has_comma", "n_lines")}


def step_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with outputs and times of which some are empty, short or nought."""
    k = F.col("k")
    output = F.when(k % 40 == 0, "").when(k % 30 == 7, "ok").otherwise(F.concat(F.lit("a longer answer about "), k.cast("string")))
    steps = activity.event_steps(spark, sf_dir).withColumns(
        {"raw_output": output, "latency_ms": F.when(k % 50 == 9, F.lit(0.0)).otherwise(F.col("latency_ms"))}
    )
    return checks.step_checks(steps, "verifier").select("event_id", "run_id", "agent", "check")


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns that name their neighbours; some name none, a missing one, or a later one as parent."""
    kind, step = F.col("conv_id") % 10, F.col("step")
    parent = (
        F.when((kind == 3) & (step == 3), 99).when((kind == 4) & (step == 2), 4)
        .when((kind == 5) & (step == 3), None).when(step > 1, step - 1)
    )
    child = F.when((kind == 6) & (step == 2), 50).otherwise(step + 1)
    return activity.conversation_steps(spark, sf_dir).select(
        "run_id", "step", parent.cast("string").alias("parent_step"), child.cast("string").alias("child_step")
    )


def step_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.chains(_linked(spark, sf_dir)).select("run_id", "step", "chain", "end_step", "hops", "unlinked", "dangling")


def approval_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a checker step; one is approved if all of its checks are."""
    checked = activity.event_steps(spark, sf_dir).where(F.col("agent") == "verifier").groupBy("run_id", "workflow").agg(
        F.min("timestamp").alias("timestamp"), F.bool_and(F.col("k") % 4 != 0).alias("approved")
    )
    found = checks.approval_streaks(checked)
    return found.select("run_id", "workflow", "approved", "window_runs", "rejections", "always_approves")


def circular_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are asked about the turn before, in some conversations about the one before that."""
    steps = activity.conversation_steps(spark, sf_dir)
    back = F.when(F.col("conv_id") % 7 == 2, 2).otherwise(1)
    shown = steps.select("run_id", (F.col("pos") + back).alias("pos"), F.col("raw_output").alias("raw_input"))
    return checks.circular_checks(steps.join(shown, ["run_id", "pos"], "left"), "assistant")


def handoff_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States handed on between turns; every fourth turn recorded what it filtered."""
    turns = activity.conversation_handoffs(activity.conversation_steps(spark, sf_dir))
    after = values.parse_state(F.col("returned_text"))
    states = turns.withColumns({
        "input_state": values.parse_state(F.col("input_text")), "output_state": after,
        "filtered_state": F.when(F.col("pos") % 4 == 0, after),
    })
    found = checks.handoff_contracts(states, CONTRACTS)
    lists = (F.array_join(c, ",").alias(c) for c in ("missing_keys", "dropped_keys", "mutated_keys"))
    return found.select("run_id", "step", "agent", "next_agent", *lists, "shrunk")


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as steps of runs of eight; some are null, zero, short or drawn to one side."""
    i = F.col("vec_id")
    vector = F.col("embedding").cast("array<double>")
    drawn = F.transform(vector, lambda x: x + 0.3)
    shaped = (
        F.when(i % 11 == 0, None).when(i % 13 == 0, F.transform(vector, lambda x: F.lit(0.0)))
        .when(i % 17 == 0, F.slice(vector, 1, 5)).when(i % 3 == 0, drawn).otherwise(vector)
    )
    return activity.read(spark, sf_dir, "embeddings").select(
        F.floor(i / 8).alias("group"), F.concat(F.lit("emb_"), F.floor(i / 8).cast("string")).alias("run_id"),
        F.concat(F.lit("agent_"), (F.col("label") % 3).cast("string")).alias("agent"), (i % 8).alias("pos"), shaped.alias("embedding"),
    )


def embedding_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of vectors against the next one, agent by agent."""
    pairs, compared = _embedding_diff(spark, sf_dir)
    return compared.select("run_a", "run_b", "agent", "ord", F.round("similarity", 6).alias("similarity"), "reason")


def embedding_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, compared = _embedding_diff(spark, sf_dir)
    found = diff.diff_runs(pairs, compared)
    return found.select("run_a", "run_b", "first_divergence", F.round("overall_similarity", 6).alias("overall_similarity"))


def _embedding_diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    steps = _embedded(spark, sf_dir)
    pairs = steps.select("group").distinct().selectExpr("concat('emb_', group) AS run_a", "concat('emb_', group + 1) AS run_b")
    return pairs, diff.embedding_diff(pairs, steps.drop("group"))


def anomaly_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over anomalies alone: evidence that never decides."""
    steps = activity.ordered_event_steps(spark, sf_dir)
    runs = steps.groupBy("run_id").agg(F.min("timestamp").alias("timestamp"))
    found = metrics.anomaly_evidence(metrics.step_metrics(steps.withColumn("step", F.lit(None).cast("bigint")), metrics.baseline(steps, runs)))
    return resolve(runs.select("run_id"), found).select("run_id", "primary_cause", "priority_level", "primary_agent", "evidence_count")


def _given(frames: analysis.TraceFrames, confidence: Column, applies: Column) -> DataFrame:
    """One finding per event that applies, by an analyzer of our own."""
    given = {
        "source": F.lit("own"), "rule_id": F.lit("own_v1"), "category": F.lit("execution"), "severity": F.lit("low"), "agent": F.col("agent"),
        "value": F.lit("FAIL"), "confidence": confidence, "analyzer_ord": F.lit(9), "emit_seq": F.col("pos"), "emit_idx": F.lit(0),
    }
    columns = (given.get(c, F.lit(None)).cast(t).alias(c) for c, t in schema.EVIDENCE_COLUMNS if c != "run_id")
    return frames.steps.where(applies).select("run_id", *columns)


def _raises(_: analysis.TraceFrames) -> DataFrame:
    raise LookupError("no such agent")


def _own_analyzers() -> dict[str, analysis.Analyzer]:
    k = F.col("k")
    return {
        **analysis.DEFAULT_ANALYZERS,
        "raises": _raises,
        "breaks": lambda f: _given(f, F.when(k == 7, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.lit(0.5)), k < 9),
        "careless": lambda f: _given(f, F.when(k % 10 == 3, F.lit(1.5)).otherwise(F.lit(0.5)), k.isin(3, 4)),
        "picky": isolation.OwnAnalyzer(
            lambda f: _given(f, F.lit(0.25), k == 5), lambda _: "CASE WHEN coalesce(n_steps, 0) < 5 THEN 'Too few steps' END"
        ),
    }


def _guarded(spark: SparkSession, sf_dir: str) -> analysis.TraceFrames:
    """Event runs, some with counts that could not be read, and nations as runs without steps."""
    steps = activity.ordered_event_steps(spark, sf_dir).withColumn("extraction_failed", F.col("k") % 97 == 5)
    idle = activity.read(spark, sf_dir, "nation").select(F.concat(F.lit("idle_"), F.col("n_nationkey").cast("string")).alias("run_id"))
    runs = activity.event_steps(spark, sf_dir).select("run_id").distinct().unionByName(idle)
    return analysis.TraceFrames(runs, steps, steps, positions=False)


def analysis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every analyzer for every run; one raises, one breaks at a row, one is careless, one skips."""
    return isolation.guard(_guarded(spark, sf_dir), _own_analyzers()).status


def guarded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that an analysis with broken analyzers still has, by rule."""
    found = isolation.guard(_guarded(spark, sf_dir), _own_analyzers()).evidence
    return found.where("source = 'own' OR rule_id IN ('skipped_step_v1', 'tool_failure_v1')").groupBy("rule_id").agg(F.count("*").alias("findings"))


CHECKS = {
    f.__name__: f
    for f in (
        step_checks, step_chains, approval_streaks, circular_checks, handoff_contracts, embedding_diff, embedding_divergence,
        anomaly_verdicts, analysis_status, guarded_evidence,
    )
}
