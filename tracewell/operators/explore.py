"""Queries of a run explorer: lookup, filtered top-n, cards, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import DEFAULT, Config, STEP_CHUNK
from tracewell.functions import text
from tracewell.operators import metrics
from tracewell.operators.ranking import attach_to_steps


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def list_runs(
    runs: DataFrame, limit: int = 50, status: str | None = None, workflow: str | None = None
) -> DataFrame:
    """Newest runs, optionally of one status or workflow."""
    if status is not None:
        runs = runs.where(F.col("status") == status)
    if workflow is not None:
        runs = runs.where(F.col("workflow") == workflow)
    return metrics.newest_runs(runs, limit)


def get_steps(steps: DataFrame, run_id: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return (
        steps.where(F.col("run_id") == run_id)
        .select(
            "step",
            "agent",
            F.coalesce("status", F.lit("unknown")).alias("status"),
            F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
            *(F.coalesce(c, zero).alias(c) for c in ("tokens_prompt", "tokens_completion", "tokens_total")),
        )
        .orderBy("step")
    )


def explorer_rows(runs: DataFrame, steps: DataFrame, topics: DataFrame, limit: int | None = 50) -> DataFrame:
    """Newest runs (all without a limit) with step sums and topic.  Steps are summed for those runs only."""
    top = metrics.newest_runs(runs.select("run_id", "workflow", "timestamp", "status"), limit)
    sums = (
        (steps if limit is None else metrics.steps_of(steps, top))
        .groupBy("run_id")
        .agg(
            F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("latency_ms"),
            F.sum(F.coalesce("tokens_total", F.lit(0).cast("bigint"))).alias("tokens_total"),
            F.count("*").alias("step_count"),
        )
    )
    named = topics if limit is None else metrics.steps_of(topics, top)
    zero = F.lit(0).cast("bigint")
    return (
        top.join(sums, "run_id", "left")
        .join(named, "run_id", "left")
        .select(
            "run_id",
            "workflow",
            F.when(F.coalesce("topic", F.lit("")) != "", F.col("topic")).otherwise(F.col("workflow")).alias("topic"),
            text.format_time(F.col("timestamp")).alias("timestamp"),
            "status",
            F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
            F.coalesce("tokens_total", zero).alias("tokens_total"),
            F.coalesce("step_count", zero).alias("step_count"),
        )
    )


def with_verdict(rows: DataFrame, verdicts: DataFrame, loss: DataFrame) -> DataFrame:
    """Add cause, agent and display verdict; runs without a verdict are UNKNOWN."""
    v = verdicts.select("run_id", "primary_cause", "priority_level", "primary_agent")
    lost = loss.select("run_id", F.col("verdict").alias("loss_verdict"))
    return (
        rows.join(v, "run_id", "left")
        .join(lost, "run_id", "left")
        .withColumn(
            "verdict",
            F.coalesce(
                "loss_verdict", F.when(F.col("priority_level") == "P5", F.lit("PASS")), F.lit("UNKNOWN")
            ),
        )
        .drop("loss_verdict")
    )


def cards(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row of totals over explorer rows that carry their verdict."""
    analysed = F.col("priority_level").isNotNull()
    tokens = F.coalesce(F.sum("tokens_total"), F.lit(0).cast("bigint"))
    return rows.agg(
        F.count("*").alias("total_runs"),
        F.count_if(analysed).alias("analyzed_runs"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        tokens.alias("total_tokens"),
        (tokens * config.cost_per_token).alias("cost_estimate"),
        F.count_if(analysed & ~F.col("verdict").isin("PASS", "UNKNOWN")).alias("warnings"),
    )


def timeline(steps: DataFrame, states: DataFrame, state: Column, chunk: int = STEP_CHUNK) -> DataFrame:
    """Steps with their share of the run maximum and the *last* state of their agent."""
    latest = states.groupBy("run_id", "agent").agg(
        F.max_by(state, "pos").alias("agent_state"), F.max("pos").alias("_last_pos")
    )
    shared = metrics.step_share(steps, chunk)
    return attach_to_steps(shared, latest, ("run_id", "agent"), chunk)
