"""How findings and verdicts agree with labelled runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rules that ought to fire on each category of labelled runs.
EXPECTED_RULES = (
    ("execution_failure", ("tool_failure_v1", "missing_tool_output_v1")),
    ("workflow_failure", ("skipped_step_v1", "wrong_order_v1")),
    ("reasoning_failure", ("hallucination_v1", "researcher_quality_v1", "information_loss_v1")),
    ("verification_failure", ("verifier_passthrough_v1",)),
)


def label_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("category").agg(F.count("*").alias("runs"))


def fired(labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per labelled run: number of findings, and whether an expected rule fired."""
    expected = F.lit(False)
    for category, rules in EXPECTED_RULES:
        expected = expected | ((F.col("category") == category) & F.col("rule_id").isin(*rules))
    # one row per (run, rule) before the join, however often a rule fired
    found = evidence.groupBy("run_id", "rule_id").agg(F.count("*").alias("n"))
    return (
        labels.select("run_id", "category", "expected_primary_agent")
        .join(found, "run_id", "left")
        .groupBy("run_id", "category", "expected_primary_agent")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("findings"),
            F.coalesce(F.max(expected & F.col("rule_id").isNotNull()), F.lit(False)).alias("expected_rule_fired"),
        )
    )


def rule_recall(per_run: DataFrame) -> DataFrame:
    """Per category: labelled runs, runs with any finding, runs with an expected rule."""
    return per_run.groupBy("category").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("findings") > 0).alias("runs_with_findings"),
        F.count_if("expected_rule_fired").alias("runs_with_expected_rule"),
        F.avg(F.col("expected_rule_fired").cast("double")).alias("recall"),
    )


def false_positives(per_run: DataFrame) -> DataFrame:
    """Runs labelled as passing on which something fired anyway."""
    return per_run.where((F.col("category") == "pass") & (F.col("findings") > 0))


def confusion(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Category × (cause, priority): runs, and how many blame the labelled agent."""
    joined = labels.select("run_id", "category", "expected_primary_agent").join(verdicts, "run_id")
    return joined.groupBy("category", "primary_cause", "priority_level").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("expected_primary_agent").eqNullSafe(F.col("primary_agent"))).alias("agent_matches"),
    )
