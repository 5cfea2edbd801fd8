"""Analysis of all runs: every analyzer, one verdict per run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.config import DEFAULT, Config
from tracewell.operators import arbiter, extract, normalize, rules


@dataclass(frozen=True)
class TraceFrames:
    """Frames an analyzer may read.  Analyzers must not modify or collect them.

    ``extracted`` is None when no evidence counts are known; the count rules then
    have nothing to say.  ``steps`` may carry the counts itself.  ``positions`` says
    whether ``pos`` of the steps is their list position or only orders them.
    """

    runs: DataFrame
    steps: DataFrame
    extracted: DataFrame | None = None
    config: Config = field(default=DEFAULT)
    positions: bool = True

    @cached_property
    def profile(self) -> DataFrame:
        return rules.profile(self.steps, self.extracted, self.config)

    @cached_property
    def loss(self) -> DataFrame | None:
        return None if self.extracted is None else rules.information_loss(self.profile, self.config)


Analyzer = Callable[[TraceFrames], DataFrame]


@dataclass(frozen=True)
class ProfileAnalyzer:
    """An analyzer whose rules all read the one-row-per-run profile.

    It works alone like any analyzer; used together, all of them share one pass.
    """

    findings: Callable[[TraceFrames], list[rules.Finding]]
    needs_counts: bool = False

    def applies_to(self, frames: TraceFrames) -> bool:
        return frames.extracted is not None or not self.needs_counts

    def __call__(self, frames: TraceFrames) -> DataFrame:
        found = self.findings(frames) if self.applies_to(frames) else []
        if not found:
            return frames.runs.sparkSession.createDataFrame([], schema.ddl(schema.EVIDENCE_COLUMNS))
        return rules.emit(frames.profile, found)


def tool_calls(frames: TraceFrames) -> DataFrame:
    return rules.tool_evidence(frames.steps)


def ground_truth_validator(frames: TraceFrames) -> DataFrame:
    finals = rules.final_outputs(frames.steps)
    return rules.ground_truth_evidence(rules.ground_truth(frames.runs, finals, frames.config), frames.config)


DEFAULT_ANALYZERS: dict[str, Analyzer] = {
    "tool_calls": tool_calls,
    "counts": ProfileAnalyzer(lambda f: rules.counts_findings(f.config), needs_counts=True),
    "information_loss": ProfileAnalyzer(lambda f: rules.loss_findings(f.config), needs_counts=True),
    "workflow": ProfileAnalyzer(lambda f: rules.workflow_findings(f.config, f.positions)),
}
ALL_ANALYZERS: dict[str, Analyzer] = {"ground_truth": ground_truth_validator, **DEFAULT_ANALYZERS}


def collect_evidence(frames: TraceFrames, analyzers: dict[str, Analyzer] = ALL_ANALYZERS) -> DataFrame:
    """Findings of all analyzers.  Own analyzers are added as further entries.

    Rules over the run profile are evaluated together, so the steps are condensed
    once however many such rules there are.
    """
    columns = [c for c, _ in schema.EVIDENCE_COLUMNS]
    on_profile = [
        a for a in analyzers.values() if isinstance(a, ProfileAnalyzer) and a.applies_to(frames)
    ]
    parts = [a(frames) for a in analyzers.values() if not isinstance(a, ProfileAnalyzer)]
    if on_profile:
        together = [f for a in on_profile for f in a.findings(frames)]
        parts.append(rules.emit(frames.profile, together))
    return reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))


def analyze(frames: TraceFrames, analyzers: dict[str, Analyzer] = ALL_ANALYZERS) -> DataFrame:
    """One verdict per run."""
    return arbiter.resolve(frames.runs, collect_evidence(frames, analyzers))


def frames_from_documents(docs: DataFrame, config: Config = DEFAULT) -> TraceFrames:
    """Frames of trace documents, counts taken from the agents' own output."""
    steps = normalize.normalize_steps(docs)
    return TraceFrames(normalize.normalize_runs(docs), steps, extract.counts_from_output(steps), config)


def loss_analysis(frames: TraceFrames) -> DataFrame:
    """The short analysis: information loss alone decides.

    Runs without an upstream or downstream step get an ``error`` and no verdict.
    """
    both = frames.profile.select(
        "run_id", (F.col("up_failed").isNotNull() & F.col("down_failed").isNotNull()).alias("both")
    )
    evidence = DEFAULT_ANALYZERS["information_loss"](frames)
    judged = frames.runs.select("run_id").join(both, "run_id", "left")
    complete = F.coalesce("both", F.lit(False))
    verdicts = arbiter.resolve(judged.where(complete), evidence)
    return judged.select(
        "run_id", F.when(~complete, F.lit(f"Missing {frames.config.upstream} or {frames.config.downstream} step")).alias("error")
    ).join(verdicts, "run_id", "left")
