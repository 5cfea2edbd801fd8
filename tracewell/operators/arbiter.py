"""One reproducible verdict per run out of any number of findings.

The winner of a run is a ``min_by`` under a total order, so partial results are
combined before the shuffle and no task ever lists the findings of a run.  The
ordered list itself is a table of its own (``ordered_evidence``), one row per
finding, so that it stays whole for runs with any number of findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions.values import quoted
from tracewell.operators.ranking import dense_position

# Priority of each evidence source; unlisted sources are P5.
SOURCE_PRIORITY = {
    "ground_truth": 1,
    "rule_engine": 2,
    "workflow_validator": 3,
    "consistency_validator": 3,
    "metrics_analyzer": 4,
    "evidence_extraction": 4,
    "diff_engine": 4,
}
# Sources that can decide a verdict, with the wording of the reason.
DECIDING = {
    "ground_truth": (1, "P1 ground truth mismatch: "),
    "rule_engine": (2, "P2 rule match: "),
    "workflow_validator": (3, "P3 Workflow violation: "),
}
NO_RULE_LAST = "zzz"  # fixed value: findings without a rule sort after all rules
NO_EVIDENCE_REASON = "No evidence collected — P5 fallback."  # fixed value
UNMATCHED_REASON = "No P2 rule matched — P5 fallback."  # fixed value



def _priority(table: dict[str, int]) -> str:
    cases = " ".join(f"WHEN {quoted(source)} THEN {rank}" for source, rank in table.items())
    return f"CASE source {cases} ELSE 5 END"


def rank_evidence(evidence: DataFrame) -> DataFrame:
    """Add priority ``rank``, deciding rank ``eff_rank`` and ``tiebreak``."""
    return evidence.selectExpr(
        "*",
        f"{_priority(SOURCE_PRIORITY)} AS rank",
        f"{_priority({s: r for s, (r, _) in DECIDING.items()})} AS eff_rank",
        f"IF(coalesce(rule_id, '') = '', '{NO_RULE_LAST}', rule_id) AS tiebreak",
    )


def ordered_evidence(evidence: DataFrame) -> DataFrame:
    """Findings with ``evidence_no``, their 1-based place in the run's bundle."""
    order = ["rank", "tiebreak", "analyzer_ord", "emit_seq", "emit_idx"]
    return dense_position(rank_evidence(evidence), ["run_id"], order, "evidence_no").withColumn(
        "evidence_no", F.col("evidence_no") + 1
    )


def resolve(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdict of every run in ``runs``; runs without findings fall back to P5."""
    order = "tiebreak, analyzer_ord, emit_seq, emit_idx"
    aggregates = (
        "min_by(struct(source, eff_rank, rule_id, category, agent, confidence), "
        f"struct(eff_rank, {order})) AS best",
        # the first rule of the bundle order, which explanations quote
        f"min_by(rule_id, struct(rank, {order})) FILTER (WHERE rule_id IS NOT NULL) AS first_rule",
        "count(*) AS evidence_count",
        "count(rule_id) AS rule_count",
        "max(source = 'ground_truth') AS grounded",
    )
    best = rank_evidence(evidence).groupBy("run_id").agg(*(F.expr(e) for e in aggregates))
    decided = "coalesce(best.eff_rank < 5, false)"
    wording = " ".join(f"WHEN {rank} THEN {quoted(words)}" for rank, words in DECIDING.values())
    return (
        runs.select("run_id")
        .join(best, "run_id", "left")
        .selectExpr(
            "run_id",
            f"CASE WHEN NOT {decided} THEN 'unknown' WHEN best.eff_rank = 3 THEN 'workflow' "
            "ELSE coalesce(best.category, 'unknown') END AS primary_cause",
            "concat('P', coalesce(best.eff_rank, 5)) AS priority_level",
            "coalesce(grounded, false) AS grounded",
            f"IF({decided}, best.agent, NULL) AS primary_agent",
            f"CASE WHEN best IS NULL THEN {quoted(NO_EVIDENCE_REASON)} "
            f"WHEN NOT {decided} THEN {quoted(UNMATCHED_REASON)} "
            f"ELSE concat(CASE best.eff_rank {wording} END, coalesce(best.rule_id, 'unknown'), "
            "' (confidence=', CAST(bround(best.confidence * 100, 0) AS BIGINT), '%)') END AS summary",
            f"IF({decided}, best.rule_id, NULL) AS deciding_rule",
            f"IF({decided}, best.confidence, NULL) AS confidence",
            "first_rule",
            "coalesce(evidence_count, 0L) AS evidence_count",
            "coalesce(rule_count, 0L) AS rule_count",
            f"'{schema.SCHEMA_VERSION}' AS schema_version",
        )
    )


def bundles(runs: DataFrame, evidence: DataFrame, chunk: int) -> DataFrame:
    """Verdicts with their findings nested, at most ``chunk`` to a row.

    ``part`` is 0 for ordinary runs; a run with more findings has further parts.
    """
    fields = ("evidence_no", *(c for c, _ in schema.EVIDENCE_COLUMNS if c not in ("run_id", "emit_seq", "emit_idx", "analyzer_ord")))
    nested = (
        ordered_evidence(evidence)
        .withColumn("part", F.floor((F.col("evidence_no") - 1) / chunk))
        .groupBy("run_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("evidence"))
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("evidence_count") / chunk) - 1).cast("bigint")
    return (
        resolve(runs, evidence)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .join(nested, ["run_id", "part"], "left")
        .withColumn("rule_matches", F.filter("evidence", lambda e: e["rule_id"].isNotNull()))
    )


def coarse_verdict(verdicts: DataFrame, loss: DataFrame) -> DataFrame:
    """Add ``verdict``: PASS for P5, else the loss verdict, else WARNING."""
    seen = loss.select("run_id", F.col("verdict").alias("loss_verdict"))
    return verdicts.join(seen, "run_id", "left").withColumn(
        "verdict",
        F.when(F.col("priority_level").isNull(), F.lit("UNKNOWN"))
        .when(F.col("priority_level") == "P5", F.lit("PASS"))
        .otherwise(F.coalesce("loss_verdict", F.lit("WARNING"))),
    )
