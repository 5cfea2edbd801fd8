"""Thresholds and roles, passed explicitly to the operators that need them."""

from __future__ import annotations

from dataclasses import dataclass

# Number of consecutive step positions that may share one task or one nested
# document.  A run longer than this is processed as several chunks.
STEP_CHUNK = 100_000
DOCUMENT_CHUNK = 1_000
PROMPT_CHUNK = 1_000


@dataclass(frozen=True)
class Config:
    """Rule and metric settings.

    The defaults are fixed values: results only agree with published verdicts
    when they are kept.
    """

    # metrics
    latency_threshold_ms: float = 5000.0
    latency_stddev_multiplier: float = 2.5
    token_stddev_multiplier: float = 2.5
    min_runs_for_baseline: int = 5
    # how many of the newest runs count; None: all
    baseline_runs: int | None = None
    summary_runs: int | None = None
    cost_runs: int | None = None
    cost_per_token: float = 0.000005
    # rules
    ground_truth_similarity: float = 0.85
    divergence_similarity: float = 0.85
    min_sources: int = 1
    entity_gain_threshold: int = 0
    severe_delta: int = 3
    moderate_delta: int = 1
    # roles
    required_agents: tuple[str, ...] = ("researcher", "writer", "verifier")
    upstream: str = "researcher"
    downstream: str = "writer"
    checker: str = "verifier"


DEFAULT = Config()
