"""Latency and token metrics, the statistical baseline, and run roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.config import DEFAULT, Config, STEP_CHUNK
from tracewell.operators import rules
from tracewell.operators.ranking import attach_to_steps


def last_failure(status: Column, order: Column, otherwise: Column) -> Column:
    """Status of the last failed step, as an aggregate over number buffers only."""
    failure = F.max(F.when(status == "FAILURE", order))
    error = F.max(F.when(status == "ERROR", order))
    return (
        F.when(error.isNotNull() & (failure.isNull() | (error >= failure)), F.lit("ERROR"))
        .when(failure.isNotNull(), F.lit("FAILURE"))
        .otherwise(otherwise)
    )


def roll_up(steps: DataFrame, order: str = "pos", status: str = "SUCCESS") -> DataFrame:
    """Totals and final status of each run, from its steps."""
    return steps.groupBy("run_id", "workflow").agg(
        F.min("timestamp").alias("timestamp"),
        last_failure(F.col("status"), F.col(order), F.lit(status)).alias("status"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.sum("tokens_total").alias("total_tokens"),
        F.count("*").alias("step_count"),
    )


def newest_runs(runs: DataFrame, limit: int | None) -> DataFrame:
    """The newest runs, all without a limit; equal times are ordered by run_id."""
    return runs if limit is None else runs.orderBy(F.desc("timestamp"), "run_id").limit(limit)


def steps_of(steps: DataFrame, some_runs: DataFrame) -> DataFrame:
    """Steps of some runs.  Spark broadcasts their ids if it finds them small."""
    return steps.join(some_runs.select("run_id"), "run_id", "left_semi")


def baseline(steps: DataFrame, runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row: mean and sample deviation of latency and tokens over all runs, or the newest.

    Inactive (``active`` false) with too few runs or no steps.  ``runs`` may list
    runs that have no steps; they count towards the minimum.
    """
    recent = newest_runs(runs.select("run_id", "timestamp"), config.baseline_runs)
    measured = (steps if config.baseline_runs is None else steps_of(steps, recent)).agg(
        F.count("latency_ms").alias("n_steps"),
        F.avg("latency_ms").alias("latency_mean"),
        F.coalesce(F.stddev_samp("latency_ms"), F.lit(0.0)).alias("latency_std"),
        F.avg("tokens_total").alias("token_mean"),
        F.coalesce(F.stddev_samp("tokens_total"), F.lit(0.0)).alias("token_std"),
    )
    n_runs = recent.agg(F.count("*").alias("n")).scalar()
    return measured.withColumn("n_runs", n_runs).withColumn(
        "active", (F.col("n_runs") >= config.min_runs_for_baseline) & (F.col("n_steps") > 0)
    )


def _whole(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint").cast("string")


def step_metrics(steps: DataFrame, base: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Per-step metrics with anomaly flags and their reasons.

    The baseline enters as a scalar subquery: one row computed once, no join.
    """
    latency, tokens = F.col("latency_ms"), F.col("tokens_total")
    over = latency > config.latency_threshold_ms
    reasons = [
        F.when(
            over,
            F.concat(F.lit("latency "), _whole(latency), F.lit(f"ms > threshold {config.latency_threshold_ms:.0f}ms")),
        )
    ]
    if base is not None:
        steps = steps.withColumn("_b", base.select(F.struct("*")).scalar())

        def unusual(x: Column, what: str, mean: str, std: str, times: float, unit: str) -> Column:
            m, s = F.col(f"_b.{mean}"), F.col(f"_b.{std}")
            return F.when(
                F.col("_b.active") & (s > 0) & (x > m + times * s),
                F.concat(
                    F.lit(f"{what} "), _whole(x), F.lit(f"{unit} > statistical threshold ("), _whole(m),
                    F.lit(f" + {times}σ)"),
                ),
            )

        reasons += [
            unusual(latency, "latency", "latency_mean", "latency_std", config.latency_stddev_multiplier, "ms"),
            unusual(tokens, "tokens", "token_mean", "token_std", config.token_stddev_multiplier, ""),
        ]
    return steps.withColumn("anomaly_reasons", F.array_compact(F.array(*reasons))).select(
        "run_id",
        "pos",
        "step",
        "agent",
        "latency_ms",
        over.alias("latency_flag"),
        F.lit(config.latency_threshold_ms).alias("latency_threshold_ms"),
        "tokens_prompt",
        "tokens_completion",
        "tokens_total",
        latency.alias("execution_time_ms"),
        (F.size("anomaly_reasons") > 0).alias("is_anomalous"),
        "anomaly_reasons",
        F.lit(schema.SCHEMA_VERSION).alias("schema_version"),
    )


def run_metrics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Run totals with slowest and fastest agent; runs without steps get zeros."""
    per_run = metrics.groupBy("run_id").agg(
        F.sum("latency_ms").alias("total_latency_ms"),
        F.sum("tokens_total").alias("total_tokens"),
        F.sum("execution_time_ms").alias("total_execution_time_ms"),
        F.count("*").alias("step_count"),
        # the first of equally slow (fast) steps wins
        F.max_by("agent", F.struct("latency_ms", -F.col("step"))).alias("slowest_step"),
        F.min_by("agent", F.struct("latency_ms", "step")).alias("fastest_step"),
        F.count_if("is_anomalous").alias("anomalous_count"),
    )
    joined = runs.select("run_id", "workflow").join(per_run, "run_id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "run_id",
        "workflow",
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total_latency_ms", "total_execution_time_ms")),
        *(F.coalesce(c, zero).alias(c) for c in ("total_tokens", "step_count", "anomalous_count")),
        "slowest_step",
        "fastest_step",
        (F.coalesce("anomalous_count", zero) > 0).alias("has_anomalies"),
    )


def agent_latency(metrics: DataFrame) -> DataFrame:
    """Latency of each agent's last step per run, one row per (run, agent)."""
    return metrics.groupBy("run_id", "agent").agg(F.max_by("latency_ms", "step").alias("latency_ms"))


def anomalous_steps(metrics: DataFrame) -> DataFrame:
    """The anomalous steps of all runs; ordering by (run_id, step) gives the lists."""
    return metrics.where("is_anomalous").select("run_id", "step", "agent", "anomaly_reasons")


def latest_run(runs: DataFrame) -> DataFrame:
    return newest_runs(runs, 1)


def agent_summary(steps: DataFrame, runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Latency and tokens per agent over all runs, or the newest; ``run_count`` counts steps."""
    recent = newest_runs(runs.select("run_id", "timestamp"), config.summary_runs)
    latency = F.coalesce("latency_ms", F.lit(0.0))
    tokens = F.coalesce("tokens_total", F.lit(0).cast("bigint"))
    return (
        (steps if config.summary_runs is None else steps_of(steps, recent))
        .groupBy("agent")
        .agg(
            F.avg(latency).alias("avg_latency_ms"),
            F.max(latency).alias("max_latency_ms"),
            F.avg(tokens).alias("avg_tokens"),
            F.sum(tokens).alias("total_tokens"),
            F.count("*").alias("run_count"),
        )
    )


def cost_estimate(runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Price of all tokens of all runs, or the newest, from their roll-ups."""
    recent = newest_runs(runs, config.cost_runs)
    return recent.agg(
        F.count("*").alias("runs"),
        F.coalesce(F.sum("total_tokens"), F.lit(0).cast("bigint")).alias("total_tokens"),
        (F.coalesce(F.sum("total_tokens"), F.lit(0)) * config.cost_per_token).alias("cost_estimate"),
    )


def long_metrics(steps: DataFrame) -> DataFrame:
    """Five (name, value, unit) rows per step."""
    as_double = {
        c: F.col(c).cast("double")
        for c in ("latency_ms", "tokens_prompt", "tokens_completion", "tokens_total")
    }
    as_double["execution_time_ms"] = F.col("latency_ms").cast("double")
    names = list(as_double)
    return (
        steps.select("run_id", "step", "agent", *(v.alias(k) for k, v in as_double.items()))
        .unpivot(["run_id", "step", "agent"], names, "metric_name", "metric_value")
        .withColumn("metric_unit", F.when(F.col("metric_name").endswith("_ms"), F.lit("ms")).otherwise(F.lit("tokens")))
        .withColumn("schema_version", F.lit(schema.SCHEMA_VERSION))
    )


def metrics_for_run(metrics: DataFrame, run_id: str) -> DataFrame:
    return metrics.where(F.col("run_id") == run_id).orderBy("step", "metric_name")


def step_share(steps: DataFrame, chunk: int = STEP_CHUNK, unranked: DataFrame | None = None) -> DataFrame:
    """Each step's latency as a share of its run's maximum, with the run totals.

    ``unranked`` may name the same steps before they got positions; the totals are
    then taken from there and the ranking is done once.
    """
    per_run = (steps if unranked is None else unranked).groupBy("run_id").agg(
        F.max("latency_ms").alias("max_latency_ms"),
        F.sum("latency_ms").alias("run_latency_ms"),
        F.sum("tokens_total").alias("run_tokens"),
        F.count("*").alias("run_steps"),
        (F.count("*") - 1).alias("_last_pos"),
    )
    share = F.when(F.col("max_latency_ms") == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), F.col("latency_ms") / F.col("max_latency_ms") * 100)
    )
    return attach_to_steps(steps, per_run, chunk=chunk).withColumn("latency_pct", share)


def anomaly_evidence(measured: DataFrame) -> DataFrame:
    """Anomalous steps as evidence; of its own it decides no verdict, and it is in no default analysis."""
    finding = rules.Finding(
        "is_anomalous", "metrics_analyzer", "metric_anomaly_v1", "execution",
        {
            "agent": "agent", "step": "step", "severity": "'medium'", "value": "'WARNING'",
            "description": "concat('Anomalous step: ', array_join(anomaly_reasons, '; '))",
        },
    )
    return rules.emit(measured, [finding])
