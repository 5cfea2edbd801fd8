"""Explanation texts built from verdict columns alone, never from trace content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import PROMPT_CHUNK
from tracewell.functions import text
from tracewell.operators.arbiter import ordered_evidence


def fallback_summary(verdicts: DataFrame) -> Column:
    """Fixed wording of the summary when no language model is asked."""
    hedge = F.when(F.col("grounded"), F.lit("indicates")).otherwise(F.lit("may indicate"))
    return F.concat(
        F.lit("[Fallback — LLM unavailable] The "),
        "priority_level",
        F.lit(" analysis "),
        hedge,
        F.lit(" a "),
        "primary_cause",
        F.lit(" issue attributed to "),
        F.coalesce("primary_agent", F.lit("an agent")),
        F.lit(". Rule '"),
        F.coalesce("first_rule", F.lit("unknown rule")),
        F.lit("' fired during the Arbiter evaluation."),
    )


def fallback_fix() -> Column:
    """Fixed wording of the suggested fix per cause."""
    agent = F.coalesce("primary_agent", F.lit("the agent"))
    cause = F.col("primary_cause")
    return (
        F.when(
            cause == "reasoning",
            F.concat(F.lit("Review "), agent, F.lit("'s output for hallucinated facts not present in the research.")),
        )
        .when(
            cause == "workflow",
            F.concat(
                F.lit("Check the handoff from the previous agent to "), agent, F.lit(" for dropped context.")
            ),
        )
        .when(
            cause == "execution",
            F.concat(F.lit("Investigate "), agent, F.lit(" for tool errors, timeouts, or missing outputs.")),
        )
        .when(
            cause == "verification",
            F.lit("Review the verifier's approval criteria — it may have passed a flawed output."),
        )
        .when(cause == "unknown", F.lit("Inspect the pipeline trace manually — no specific rule matched."))
        .otherwise(F.lit("Inspect the pipeline trace for anomalies."))
    )


def explain_fallback(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumns({"summary": fallback_summary(verdicts), "suggested_fix": fallback_fix()})


def _flag(column: str) -> Column:
    return F.when(F.col(column), F.lit("True")).otherwise(F.lit("False"))


def prompts(
    verdicts: DataFrame, evidence: DataFrame, chunk: int = PROMPT_CHUNK,
    max_chars: int | None = None,
) -> DataFrame:
    """Prompt texts for an explaining model, ``chunk`` findings to a text.

    Ordinary runs have the single part 0.  A run with more findings than fit gets
    further parts under the same heading, so nothing is left out.
    """
    number = F.col("evidence_no")
    # Labels of the lines below.
    line = F.concat(
        F.lit("  ["), number.cast("string"), F.lit("] rule="), F.coalesce("rule_id", F.lit("no_rule")),
        F.lit("  confidence="), text.percent(F.col("confidence")),
        F.lit("  description="), text.leading(F.col("description"), max_chars),
    )
    rule = F.when(
        F.col("rule_id").isNotNull(),
        F.concat(
            F.lit("  - rule_id="), "rule_id", F.lit("  category="), "category", F.lit("  severity="), "severity",
            F.lit("  agent="), F.coalesce("agent", F.lit("unknown")),
        ),
    )
    lines = (
        ordered_evidence(evidence)
        .select("run_id", F.floor((number - 1) / chunk).alias("part"), F.struct(number, line.alias("e"), rule.alias("r")).alias("l"))
        .groupBy("run_id", "part")
        .agg(F.array_sort(F.collect_list("l")).alias("lines"))
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("evidence_count") / chunk) - 1).cast("bigint")
    parts = verdicts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))

    def block(field: str) -> Column:
        present = F.filter(F.transform("lines", lambda x: x[field]), lambda x: x.isNotNull())
        joined = F.array_join(present, "\n")
        return F.when(F.coalesce(joined, F.lit("")) == "", F.lit("  (none)")).otherwise(joined)

    language = F.when(F.col("grounded"), F.lit("Use CONFIDENT language.")).otherwise(
        F.lit("Use HEDGED language (may indicate, suggests, possible).")
    )
    # Headings and field labels of the prompt.
    body = F.concat_ws(
        "\n",
        F.lit("ANALYSIS VERDICT"),
        F.lit("════════════════"),
        F.concat(F.lit("run_id         : "), "run_id"),
        F.concat(F.lit("primary_cause  : "), "primary_cause"),
        F.concat(F.lit("priority_level : "), "priority_level"),
        F.concat(F.lit("primary_agent  : "), F.coalesce("primary_agent", F.lit("unknown"))),
        F.concat(F.lit("grounded       : "), _flag("grounded")),
        F.concat(F.lit("evidence_count : "), F.col("evidence_count").cast("string")),
        F.lit(""),
        F.lit("EVIDENCE RECORDS"),
        F.lit("────────────────"),
        block("e"),
        F.lit(""),
        F.lit("FIRED RULES"),
        F.lit("────────────"),
        block("r"),
        F.lit(""),
        F.lit("HEDGING INSTRUCTION"),
        F.lit("───────────────────"),
        F.concat(F.lit("grounded="), _flag("grounded"), F.lit(" → "), language),
        F.lit(""),
    )
    return parts.join(lines, ["run_id", "part"], "left").select("run_id", "part", body.alias("prompt"))


def verdict_report(explained: DataFrame, loss: DataFrame) -> DataFrame:
    """Markdown report per run.  Verdict and confidence are those of the information
    loss comparison; runs without one show UNKNOWN and a dash.
    """
    seen = loss.select("run_id", F.col("verdict").alias("_verdict"), F.col("confidence").alias("_confidence"))
    report = F.concat_ws(
        "\n",
        F.lit("## Verdict"),
        F.concat(F.lit("**Run:** `"), "run_id", F.lit("`")),
        F.concat(F.lit("**Verdict:** "), F.coalesce("_verdict", F.lit("UNKNOWN")), F.lit(" ("), "priority_level", F.lit(")")),
        F.concat(F.lit("**Cause:** "), "primary_cause"),
        F.concat(F.lit("**Agent:** "), F.coalesce("primary_agent", F.lit("N/A"))),
        F.concat(F.lit("**Confidence:** "), F.coalesce(text.percent(F.col("_confidence")), F.lit("—"))),
        F.concat(F.lit("**Grounded:** "), F.when(F.col("grounded"), F.lit("Yes")).otherwise(F.lit("No"))),
        F.lit(""),
        F.lit("### Root Cause"),
        F.coalesce("summary", F.lit("")),
        F.lit(""),
        F.lit("### Suggested Fix"),
        F.coalesce("suggested_fix", F.lit("")),
    )
    return explained.join(seen, "run_id", "left").select("run_id", report.alias("report"))
