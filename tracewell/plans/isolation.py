"""An analysis that outlives its analyzers, with a status of every analyzer for every run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions.values import quoted
from tracewell.operators import arbiter, normalize, rules
from tracewell.plans.analysis import ALL_ANALYZERS, Analyzer, TraceFrames, collect_evidence
from tracewell.session import materialize

NO_COUNTS = "No evidence counts known"
COUNTS_FAILED = "Extraction failed"
NONE = "CAST(NULL AS STRING)"


@dataclass(frozen=True)
class OwnAnalyzer:
    """An analyzer that tells which runs it skips.

    ``skips`` gives a SQL expression over the run's profile and columns: a reason, or null.
    """

    findings: Callable[[TraceFrames], DataFrame]
    skips: Callable[[TraceFrames], str] = lambda _: NONE

    def __call__(self, frames: TraceFrames) -> DataFrame:
        return self.findings(frames)


@dataclass(frozen=True)
class Guarded:
    """Evidence of the analyzers that worked, findings that were refused, and one status per run and analyzer."""

    evidence: DataFrame
    refused: DataFrame
    status: DataFrame


def skip_reasons(frames: TraceFrames, analyzers: dict[str, Analyzer]) -> dict[str, str]:
    """SQL of each analyzer's reason to skip a run, null where it looks at it."""
    idle = f"WHEN coalesce(n_steps, 0) = 0 THEN {quoted(rules.NO_STEPS)}"
    no_counts = f"WHEN {str(frames.extracted is None).lower()} THEN {quoted(NO_COUNTS)}"
    pair = f"Missing {frames.config.upstream} or {frames.config.downstream} step"
    lost = "" if frames.extracted is None else (
        f"WHEN up_failed IS NULL OR down_failed IS NULL THEN {quoted(pair)} WHEN up_failed OR down_failed THEN {quoted(COUNTS_FAILED)}"
    )
    known = {
        "tool_calls": f"CASE {idle} END",
        "counts": f"CASE {idle} {no_counts} END",
        "information_loss": f"CASE {idle} {no_counts} {lost} END",
        "workflow": f"CASE {idle} END",
        "ground_truth": f"CASE WHEN coalesce(expected_output, '') = '' THEN {quoted(rules.NO_EXPECTED)} "
        f"WHEN coalesce(n_steps, 0) = 0 THEN {quoted(rules.NO_STEPS_PRESENT)} END",
    }
    return {
        name: known[name] if name in known and analyzer is ALL_ANALYZERS[name] else getattr(analyzer, "skips", lambda _: NONE)(frames)
        for name, analyzer in analyzers.items()
    }


def told(error: Exception) -> str:
    """A failure in one line."""
    said = error.getCondition() if isinstance(error, PySparkException) else None
    return f"{type(error).__name__}: {said or (str(error).splitlines() or [''])[0][:200]}"


def guard(frames: TraceFrames, analyzers: dict[str, Analyzer] = ALL_ANALYZERS, name: str = "guarded") -> Guarded:
    """Run all analyzers so that none can end the analysis.

    Analyzers of the default registry are planned together and share their passes.  An own
    analyzer is called and its findings are stored by a job of its own; if either raises,
    it failed for all runs and the others go on.  Findings without a run, or with values
    outside their domain, are refused row by row; own sources may have any name.  Status
    is ok, skipped, failed or refused, with the reason.

    Frames whose own computation fails do end the analysis: no analyzer is to blame then.
    """
    columns = [c for c, _ in schema.EVIDENCE_COLUMNS]
    own = {n: a for n, a in analyzers.items() if ALL_ANALYZERS.get(n) is not a}
    shared = {n: a for n, a in analyzers.items() if n not in own}
    failed, parts = {}, []
    for id_, analyzer in own.items():
        try:
            found = materialize(analyzer(frames).select(*columns), f"{name}-evidence")
            parts.append(found.withColumn("analyzer_id", F.lit(id_)))
        except Exception as error:  # whatever it is, it is this analyzer's
            failed[id_] = told(error)
    empty = frames.runs.sparkSession.createDataFrame([], schema.ddl(schema.EVIDENCE_COLUMNS))
    evidence = collect_evidence(frames, shared) if shared else empty
    refused = empty.withColumns({"analyzer_id": F.lit(""), "violations": F.array().cast("array<string>")})
    if parts:
        checked = normalize.check_constraints(reduce(DataFrame.unionByName, parts).withColumnRenamed("source", "_source"))
        checked = checked.withColumnRenamed("_source", "source").withColumn(
            "violations", F.when(F.col("run_id").isNull(), F.array_append("violations", F.lit("run_id"))).otherwise(F.col("violations"))
        )
        evidence = evidence.select(*columns).unionByName(checked.where(F.size("violations") == 0).select(*columns))
        refused = checked.where(F.size("violations") > 0)
    return Guarded(evidence, refused, _status(frames, analyzers, failed, refused))


def _status(frames: TraceFrames, analyzers: dict[str, Analyzer], failed: dict[str, str], refused: DataFrame) -> DataFrame:
    runs = frames.runs if "expected_output" in frames.runs.columns else frames.runs.withColumn("expected_output", F.lit(None).cast("string"))
    known = runs.select("run_id", "expected_output").join(frames.profile, "run_id", "left")
    reasons = skip_reasons(frames, analyzers)
    entries = F.array(*(
        F.struct(
            F.lit(n).alias("analyzer_id"), F.lit("failed" if n in failed else "skipped").alias("status"),
            (F.lit(failed[n]) if n in failed else F.expr(f"CAST({reasons[n]} AS STRING)")).alias("reason"),
        )
        for n in analyzers
    ))
    entries = entries if analyzers else entries.cast("array<struct<analyzer_id:string,status:string,reason:string>>")
    status = known.select("run_id", F.explode(entries).alias("e")).select("run_id", "e.*")
    told_of = refused.groupBy("run_id", "analyzer_id").agg(
        F.count("*").alias("_n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("violations")))), ", ").alias("_what")
    )
    words = F.concat(F.col("_n").cast("string"), F.lit(" findings refused: "), F.col("_what"))
    return status.join(told_of, ["run_id", "analyzer_id"], "left").select(
        "run_id", "analyzer_id",
        F.when(F.col("reason").isNotNull(), F.col("status")).when(F.col("_n").isNotNull(), "refused").otherwise("ok").alias("status"),
        F.coalesce("reason", words, F.lit("")).alias("reason"),
    )


def analyze_guarded(frames: TraceFrames, analyzers: dict[str, Analyzer] = ALL_ANALYZERS) -> tuple[DataFrame, DataFrame]:
    """(verdicts, status): one verdict per run from the analyzers that worked."""
    found = guard(frames, analyzers)
    return arbiter.resolve(frames.runs, found.evidence), found.status
