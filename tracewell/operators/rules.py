"""Failure rules.

``profile`` condenses the steps of every run into one row with number-only
buffers (first position per required agent, last counts per role), so all
run-level rules cost one map-side-combined shuffle of one row per run.  Tool
rules look at single calls and need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.config import DEFAULT, Config
from tracewell.functions.similarity import sequence_ratio
from tracewell.functions.values import quoted

# Order in which analyzers are consulted on ties.
ANALYZER_ORD = {"ground_truth": 1, "rule_engine": 2, "information_loss": 3, "workflow_validator": 4}
SOURCE_OF = {"information_loss": "rule_engine"}
RULE_VERSION = "1.0.0"
LOSS_RULE = "information_loss_v1"
# What marks the text of a tool's output as a failure.
ERROR_MARKS = ("Error:", "Exception:")
# Reasons an analyzer gives for not looking at a run.
NO_STEPS = "No steps in trace"
NO_EXPECTED = "No expected_output present in trace."
NO_STEPS_PRESENT = "No steps present in trace."


@dataclass(frozen=True)
class Finding:
    """A rule: when it applies, and the evidence columns it fills in.

    ``applies`` and the values of ``fields`` are SQL expressions over the row the
    rule looks at; evidence columns without a value take the default below.
    """

    applies: str
    analyzer: str
    rule_id: str
    category: str
    fields: Mapping[str, str] = field(default_factory=dict)

    def value(self, column: str) -> str:
        defaults = {
            "analyzer_ord": str(ANALYZER_ORD.get(self.analyzer, len(ANALYZER_ORD))),  # own analyzers come last
            "emit_seq": "0",
            "emit_idx": "0",
            "source": quoted(SOURCE_OF.get(self.analyzer, self.analyzer)),
            "rule_id": quoted(self.rule_id),
            "rule_version": quoted(RULE_VERSION),
            "category": quoted(self.category),
            "severity": "'high'",
            "rule_description": self.fields.get("description", "NULL"),
            "value": "'FAIL'",
            "confidence": "1.0D",
        }
        return self.fields.get(column, defaults.get(column, "NULL"))


def emit(df: DataFrame, findings: Sequence[Finding]) -> DataFrame:
    """Evidence rows of all findings that apply to each row of ``df``.

    Only the numbers of the applying findings are exploded; the columns are looked
    up afterwards.  That keeps the generated code small with any number of rules.
    """
    numbers = ", ".join(f"IF({f.applies}, {i}, NULL)" for i, f in enumerate(findings))

    def column(name: str, kind: str) -> str:
        at: dict[str, list[str]] = {}
        for i, f in enumerate(findings):
            at.setdefault(f.value(name), []).append(str(i))
        if len(at) == 1:
            expression = next(iter(at))
        else:
            cases = " ".join(f"WHEN _hit IN ({', '.join(n)}) THEN {v}" for v, n in at.items() if v != "NULL")
            expression = f"CASE {cases} END"
        return f"CAST({expression} AS {kind}) AS {name}"

    return df.selectExpr("*", f"explode(array_compact(array({numbers}))) AS _hit").selectExpr(
        "run_id", *(column(c, t) for c, t in schema.EVIDENCE_COLUMNS if c != "run_id")
    )


# ------------------------------------------------------------------ tool calls


def tool_evidence(steps: DataFrame) -> DataFrame:
    """Tool calls without any result, and tool calls that failed."""
    # Ids, categories and wordings.
    calls = steps.selectExpr(
        "run_id", "pos", "step", "agent", "posexplode(tool_calls) AS (idx, call)"
    )
    where = {"step": "step", "emit_seq": "pos", "emit_idx": "idx", "agent": "agent"}
    name = "coalesce(call.name, 'None')"
    marked = " OR ".join(f"contains(call.output_text, {quoted(m)})" for m in ERROR_MARKS)
    return emit(
        calls,
        [
            Finding(
                "NOT call.has_output AND NOT call.has_error",
                "rule_engine",
                "missing_tool_output_v1",
                "execution",
                where | {"description": f"concat('Agent \\'', agent, '\\' called tool \\'', {name}, '\\' but no output was recorded.')"},
            ),
            Finding(
                f"call.has_error OR {marked}",
                "rule_engine",
                "tool_failure_v1",
                "execution",
                where | {"description": f"concat('Tool \\'', {name}, '\\' returned an error.')"},
            ),
        ],
    )


# ------------------------------------------------------------- run-level rules


def profile(steps: DataFrame, extracted: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row per run: step count, first position of each required agent and,
    when counts are known, the last counts of each role.

    ``extracted`` may be the steps frame itself when that carries the counts.
    """
    shape = ["count(*) AS n_steps"] + [
        f"min(pos) FILTER (WHERE agent = {quoted(name)}) AS first_{i}"
        for i, name in enumerate(config.required_agents)
    ]
    roles = {"up": config.upstream, "down": config.downstream, "check": config.checker}
    fields = {
        "step": "step", "sources": "source_count", "entities": "entity_count", "failed": "extraction_failed"
    }
    counts = [
        f"max_by({column}, pos) FILTER (WHERE agent = {quoted(name)}) AS {prefix}_{short}"
        for prefix, name in roles.items()
        for short, column in fields.items()
    ]

    def per_run(df: DataFrame, expressions: list[str]) -> DataFrame:
        return df.groupBy("run_id").agg(*(F.expr(e) for e in expressions))

    if extracted is None:
        return per_run(steps, shape)
    if extracted is steps:
        return per_run(steps, shape + counts)
    return per_run(steps, shape).join(per_run(extracted, counts), "run_id", "left")


def _spoken(role: str) -> str:
    """A role as it stands in texts."""
    return role[:1].upper() + role[1:]


def counts_findings(config: Config = DEFAULT) -> list[Finding]:
    """Rules over the last counts of upstream, downstream and checker."""
    gain = "(down_entities - up_entities)"
    limit = config.entity_gain_threshold
    up, down, check = (_spoken(r) for r in (config.upstream, config.downstream, config.checker))
    # Ids, categories and wordings; the roles in them are those of ``config``.
    return [
        Finding(
            f"NOT up_failed AND up_sources < {config.min_sources}",
            "rule_engine",
            "researcher_quality_v1",
            "reasoning",
            {
                "agent": quoted(config.upstream),
                "step": "up_step",
                "description": f"concat({quoted(up + ' source count (')}, up_sources, ') below threshold ({config.min_sources}).')",
            },
        ),
        Finding(
            f"NOT up_failed AND NOT down_failed AND {gain} > {limit}",
            "rule_engine",
            "hallucination_v1",
            "reasoning",
            {
                "agent": quoted(config.downstream),
                "step": "down_step",
                "description": f"concat({quoted(down + ' hallucinated entities (gain of ')}, {gain}, ').')",
            },
        ),
        Finding(
            # with unusable upstream counts the gain is taken as 0
            "NOT down_failed AND NOT check_failed AND down_entities = check_entities "
            f"AND IF(coalesce(up_failed, true), 0, {gain}) > {limit}",
            "rule_engine",
            "verifier_passthrough_v1",
            "verification",
            {
                "agent": quoted(config.checker),
                "step": "check_step",
                "description": quoted(f"{check} passed through hallucinated entities unchallenged."),
            },
        ),
    ]


def workflow_findings(config: Config = DEFAULT, positions: bool = True) -> list[Finding]:
    """Required agents that never ran, and neighbours that ran in reverse order.

    Without ``positions`` the steps were only ordered, and findings name no step.
    """
    required = config.required_agents
    skipped = [
        Finding(
            f"first_{i} IS NULL",
            "workflow_validator",
            "skipped_step_v1",
            "workflow",
            {
                "agent": quoted(name),
                "emit_seq": str(i),
                "description": quoted(f"Required agent '{name}' is missing from the trace."),
            },
        )
        for i, name in enumerate(required)
    ]
    reversed_pairs = [
        Finding(
            f"first_{i + 1} < first_{i}",
            "workflow_validator",
            "wrong_order_v1",
            "workflow",
            {
                "agent": quoted(later),
                "step": f"first_{i + 1} + 1" if positions else "NULL",
                "emit_seq": str(i),
                "description": quoted(f"Agent '{later}' executed before '{earlier}'."),
            },
        )
        for i, (earlier, later) in enumerate(zip(required, required[1:]))
    ]
    return skipped + reversed_pairs


# ------------------------------------------------------------ information loss

_COUNTS = {"sources": "source_count", "entities": "entity_count"}
_FAILED = "(up_failed OR down_failed)"


def _delta(s: str) -> str:
    return f"(down_{s} - up_{s})"


def _either(test: str) -> str:
    """The test on either count, with ``d`` standing for its change."""
    return "(" + " OR ".join(f"({test})".replace("{d}", _delta(s)) for s in _COUNTS) + ")"


def _loss_verdict(config: Config) -> str:
    """FAIL for a severe drop, WARNING for a small drop or a notable gain, else PASS."""
    severe = _either(f"{{d}} < 0 AND {{d}} <= -{config.severe_delta}")
    mild = _either(f"{{d}} < 0 OR ({{d}} > 0 AND {{d}} >= {config.moderate_delta})")
    return f"CASE WHEN {_FAILED} THEN 'PASS' WHEN {severe} THEN 'FAIL' WHEN {mild} THEN 'WARNING' ELSE 'PASS' END"


# Base, slope and upper bound of the confidence.
_CONFIDENCE = {"FAIL": (0.80, 0.19, 0.99), "WARNING": (0.60, 0.24, 0.84)}


def _loss_confidence(verdict: str) -> str:
    """Grows with the mean relative change; 4 decimals."""
    base, slope, top = _CONFIDENCE[verdict]
    ratio = " + ".join(f"abs{_delta(s)} / greatest(up_{s}, 1)" for s in _COUNTS)
    return f"round(least({top}D, {base}D + ({ratio}) / 2.0D * {slope}D), 4)"


def _signal(s: str) -> str:
    return f"CASE sign{_delta(s)} WHEN -1 THEN 'DROPPED' WHEN 1 THEN 'ADDED' ELSE 'PRESERVED' END"


def _severity(s: str, config: Config) -> str:
    size = f"abs{_delta(s)}"
    return (
        f"CASE WHEN {size} = 0 THEN 'NONE' WHEN {size} >= {config.severe_delta} THEN 'HIGH' "
        f"WHEN {size} >= {config.moderate_delta} THEN 'MEDIUM' ELSE 'LOW' END"
    )


def _loss_summary(verdict: str, config: Config) -> str:
    lines = [
        f"concat('  {name}: ', up_{s}, ' → ', down_{s}, IF(up_{s} = down_{s}, ' (PRESERVED)', "
        f"concat(' (', {_signal(s)}, ' ', abs{_delta(s)}, ', severity=', {_severity(s, config)}, ')')))"
        for s, name in _COUNTS.items()
    ]
    return f"concat_ws('\\n', concat('Verdict: ', {verdict}), {', '.join(lines)})"


def information_loss(runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Upstream against downstream counts of every run that has both roles."""
    known = {}
    for s in _COUNTS:
        known |= {
            f"up_{s}": f"up_{s}",
            f"down_{s}": f"down_{s}",
            f"{s}_delta": _delta(s),
            f"{s}_signal": _signal(s),
            f"{s}_severity": _severity(s, config),
        }
    return (
        runs.where("up_failed IS NOT NULL AND down_failed IS NOT NULL")
        .selectExpr("*", f"{_loss_verdict(config)} AS verdict")
        .selectExpr(
            "run_id",
            f"'{LOSS_RULE}' AS rule_id",
            "'workflow' AS rule_category",
            *(f"IF({_FAILED}, NULL, {e}) AS {name}" for name, e in known.items()),
            "verdict",
            f"CASE WHEN {_FAILED} THEN 0.0D "
            + " ".join(f"WHEN verdict = '{v}' THEN {_loss_confidence(v)}" for v in _CONFIDENCE)
            + " ELSE 1.0D END AS confidence",
            f"IF({_FAILED}, 'Rule skipped — evidence extraction failed on one or both steps.', "
            f"{_loss_summary('verdict', config)}) AS summary",
            f"NOT {_FAILED} AND {_either('{d} < 0')} AS has_information_loss",
            f"NOT {_FAILED} AND {_either('{d} > 0')} AS has_information_gain",
            f"{_FAILED} AS rule_failed",
            f"IF({_FAILED}, concat({quoted(_spoken(config.upstream) + ' extraction_failed=')}, initcap(string(up_failed)), "
            f"{quoted(', ' + _spoken(config.downstream) + ' extraction_failed=')}, initcap(string(down_failed))), NULL) AS error_message",
            f"'{schema.SCHEMA_VERSION}' AS schema_version",
        )
    )


def loss_findings(config: Config = DEFAULT) -> list[Finding]:
    """Loss and gain verdicts as evidence, always against the downstream agent.

    A small drop is a WARNING and carries the gain wording; that is intended.
    """
    moved = "'source: ', up_sources, '→', down_sources, ', entity: ', up_entities, '→', down_entities"
    # Category, severity and wording of the two outcomes.
    outcomes = {
        "FAIL": (
            "workflow",
            "high",
            "Information loss detected: sources or entities were dropped in the "
            f"{_spoken(config.upstream)} → {_spoken(config.downstream)} handoff. ",
        ),
        "WARNING": (
            "reasoning",
            "medium",
            f"Information gain detected: {_spoken(config.downstream)} introduced sources or entities "
            "not present in research findings (hallucination risk). ",
        ),
    }
    both = "up_failed IS NOT NULL AND down_failed IS NOT NULL"
    return [
        Finding(
            f"{both} AND {_loss_verdict(config)} = '{verdict}'",
            "information_loss",
            LOSS_RULE,
            category,
            {
                "agent": quoted(config.downstream),
                "severity": quoted(severity),
                "value": quoted(verdict),
                "confidence": _loss_confidence(verdict),
                "description": f"concat({quoted(words)}, {moved})",
                "evidence_detail": _loss_summary(quoted(verdict), config),
            },
        )
        for verdict, (category, severity, words) in outcomes.items()
    ]


# ---------------------------------------------------------------- ground truth


def final_outputs(steps: DataFrame) -> DataFrame:
    """Agent and output of the last list element of every run."""
    return (
        steps.groupBy("run_id")
        .agg(F.max_by(F.struct("agent", "raw_output"), "pos").alias("last"))
        .select("run_id", "last.*")
    )


def ground_truth(runs: DataFrame, finals: DataFrame, config: Config = DEFAULT, autojunk: bool = True) -> DataFrame:
    """Similarity of final and expected output for runs that state one.

    The join is one row per run on either side, and only these rows reach Python.
    """
    expected = runs.where(F.col("expected_output") != "").select("run_id", "expected_output")
    return expected.join(finals, "run_id").select(
        "run_id",
        "agent",
        "expected_output",
        F.col("raw_output").alias("actual_output"),
        sequence_ratio(F.col("expected_output"), F.col("raw_output"), autojunk).alias("similarity"),
    )


def ground_truth_evidence(compared: DataFrame, config: Config = DEFAULT) -> DataFrame:
    limit = config.ground_truth_similarity
    # Id, category, severity and wordings.
    words = f"Pipeline final output diverged from expected output. Similarity: %.2f (Threshold: {limit:.2f})"
    mismatch = Finding(
        f"similarity < {limit}D",
        "ground_truth",
        "gt_mismatch_v1",
        "reasoning",
        {
            "agent": "agent",
            "severity": "'critical'",
            "confidence": "1.0D - similarity",
            "description": "'Ground truth mismatch detected.'",
            "rule_description": f"format_string({quoted(words)}, similarity)",
            "evidence_detail": "concat('Expected:\\n', expected_output, '\\n\\nActual:\\n', actual_output)",
        },
    )
    return emit(compared, [mismatch])


# --------------------------------------------------------------------- status


def analyzer_status(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Which analyzer skipped which run, and why."""
    known = runs.select("run_id", "expected_output").join(profiles.select("run_id", "n_steps"), "run_id", "left")
    no_steps = F.coalesce("n_steps", F.lit(0)) == 0
    no_expected = F.coalesce("expected_output", F.lit("")) == ""
    reasons = {
        "rule_engine": F.when(no_steps, F.lit(NO_STEPS)),
        "workflow_validator": F.when(no_steps, F.lit(NO_STEPS)),
        "ground_truth_validator": F.when(no_expected, F.lit(NO_EXPECTED)).when(no_steps, F.lit(NO_STEPS_PRESENT)),
    }
    entries = F.array(*(F.struct(F.lit(a).alias("analyzer_id"), r.alias("skip_reason")) for a, r in reasons.items()))
    return known.select("run_id", F.explode(entries).alias("e")).select(
        "run_id",
        "e.analyzer_id",
        F.col("e.skip_reason").isNotNull().alias("skipped"),
        F.coalesce("e.skip_reason", F.lit("")).alias("skip_reason"),
    )
