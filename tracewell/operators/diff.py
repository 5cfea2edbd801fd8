"""Comparison of pairs of runs, agent by agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import DEFAULT, Config
from tracewell.functions import text


def last_steps(steps: DataFrame) -> DataFrame:
    """Last step of each agent per run, with ``ord``, the agent's first position."""
    return (
        steps.groupBy("run_id", "agent")
        .agg(
            F.min("pos").alias("ord"),
            F.max_by(F.struct("raw_output", "latency_ms", "tokens_total"), "pos").alias("last"),
        )
        .select("run_id", "agent", "ord", "last.*")
    )


def diff_steps(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Agents of run A side by side with the same agents of run B.

    ``pairs`` lists (run_a, run_b).  Agents that only B has are left out; agents B
    lacks score 0.
    """
    last = last_steps(steps)
    a = last.select(
        F.col("run_id").alias("run_a"), "agent", "ord", F.col("raw_output").alias("out_a"),
        F.coalesce("latency_ms", F.lit(0.0)).alias("lat_a"), F.coalesce("tokens_total", F.lit(0)).alias("tok_a"),
    )
    b = last.select(
        F.col("run_id").alias("run_b"), "agent", F.col("raw_output").alias("out_b"),
        F.col("latency_ms").alias("lat_b"), F.col("tokens_total").alias("tok_b"),
    )
    return (
        pairs.join(a, "run_a")
        .join(b, ["run_b", "agent"], "left")
        .select(
            "run_a",
            "run_b",
            "agent",
            "ord",
            "lat_a",
            F.coalesce("lat_b", F.lit(0.0)).alias("lat_b"),
            "tok_a",
            F.coalesce("tok_b", F.lit(0)).alias("tok_b"),
            text.jaccard(F.col("out_a"), F.col("out_b")).alias("similarity"),
        )
    )


def diff_runs(pairs: DataFrame, compared: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """First diverging agent and mean similarity of each pair."""
    diverged = F.when(F.col("similarity") < config.divergence_similarity, F.col("ord"))
    per_pair = compared.groupBy("run_a", "run_b").agg(
        F.min_by("agent", diverged).alias("first_divergence"),
        F.avg("similarity").alias("overall_similarity"),
    )
    return pairs.join(per_pair, ["run_a", "run_b"], "left").select(
        "run_a",
        "run_b",
        F.coalesce("first_divergence", F.lit("(none)")).alias("first_divergence"),
        F.coalesce("overall_similarity", F.lit(0.0)).alias("overall_similarity"),
    )


def _finite(vector: Column) -> Column:
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def cosine(a: Column, b: Column) -> tuple[Column, Column]:
    """Cosine of two vectors, and why there is none: missing, length, invalid or zero; built-in functions only."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    reason = (
        F.when(a.isNull() | b.isNull(), "missing")
        .when(F.size(a) != F.size(b), "length")
        .when(~_finite(a) | ~_finite(b), "invalid")
        .when((norm(a) == 0) | (norm(b) == 0), "zero")
    )
    return F.when(reason.isNull(), dot(a, b) / (norm(a) * norm(b))), reason


def embedding_diff(pairs: DataFrame, embedded: DataFrame) -> DataFrame:
    """Agents of run A side by side with those of run B, compared by supplied embeddings of their last steps.

    ``pairs`` lists (run_a, run_b), ``embedded`` has run_id, agent, pos and embedding.
    ``similarity`` is the cosine, 0 where there is none for the ``reason`` given; agents
    that only B has are left out.  The last step is found on numbers alone, its vector
    by an equi-join.  The result fits ``diff_runs``.
    """
    ends = embedded.groupBy("run_id", "agent").agg(F.min("pos").alias("ord"), F.max("pos").alias("pos"))
    last = ends.join(embedded.select("run_id", "agent", "pos", F.col("embedding").cast("array<double>").alias("embedding")), ["run_id", "agent", "pos"])
    a = last.select(F.col("run_id").alias("run_a"), "agent", "ord", F.col("embedding").alias("_a"))
    b = last.select(F.col("run_id").alias("run_b"), "agent", F.col("embedding").alias("_b"))
    value, reason = cosine(F.col("_a"), F.col("_b"))
    found = pairs.join(a, "run_a").join(b, ["run_b", "agent"], "left")
    return found.select("run_a", "run_b", "agent", "ord", F.coalesce(value, F.lit(0.0)).alias("similarity"), reason.alias("reason"))
