"""Column layouts of the data model and the enumerated domains."""

from __future__ import annotations

SCHEMA_VERSION = "1.0"

# The enumerations of the data model.
STEP_STATUS = ("SUCCESS", "FAILURE", "ERROR", "SKIPPED")
NODE_TYPE = ("llm", "tool", "router", "human")
FAILURE_CATEGORY = ("execution", "reasoning", "workflow", "verification", "unknown")
PRIORITY_LEVEL = ("P1", "P2", "P3", "P4", "P5")
EVIDENCE_SOURCE = (
    "rule_engine",
    "workflow_validator",
    "consistency_validator",
    "metrics_analyzer",
    "evidence_extraction",
    "diff_engine",
    "ground_truth",
)
RULE_SEVERITY = ("low", "medium", "high", "critical")

# A trace document.  States are declared STRING: the JSON reader then hands over
# the raw text of a nested object and the content of a quoted one, so both
# spellings meet in the same column.  ``first_pos`` is the list position of the
# first step; it is absent in ordinary documents and set when a very long run
# was written as several documents.
TRACE = """
  schema_version STRING, run_id STRING, workflow STRING, timestamp STRING, status STRING,
  total_latency_ms DOUBLE, total_tokens BIGINT, expected_output STRING, trace_path STRING,
  initial_state STRING, first_pos BIGINT,
  steps ARRAY<STRUCT<
    schema_version: STRING, run_id: STRING, step: INT, agent: STRING, node_type: STRING,
    input: STRING, output: STRING, expected_output: STRING, prompt: STRING,
    system_prompt: STRING, model: STRING,
    generation_params: STRUCT<temperature: DOUBLE, top_p: DOUBLE, max_tokens: BIGINT, seed: BIGINT>,
    latency_ms: DOUBLE, tokens: STRUCT<prompt: BIGINT, completion: BIGINT, total: BIGINT>,
    tool_calls: ARRAY<STRUCT<name: STRING, args: VARIANT, output: VARIANT, result: VARIANT, error: VARIANT>>,
    handoff: STRUCT<input_state: STRING, filtered_state: STRING, output_state: STRING>,
    parent_step: STRING, child_step: STRING, status: STRING, error: STRING, timestamp: STRING>>
"""

LABELS = """
  generated_at STRING, version STRING, total INT, frozen BOOLEAN, note STRING,
  runs ARRAY<STRUCT<run_id: STRING, label_id: STRING, topic: STRING, category: STRING,
    expected_verdict: STRING, expected_primary_agent: STRING, notes: STRING,
    researcher_sources: INT, researcher_entities: INT, writer_sources: INT, writer_entities: INT,
    include_verifier: BOOLEAN, has_tool_calls: BOOLEAN, skip_step: STRING, frozen: BOOLEAN>>
"""

EXTRACTION_RESPONSE = """
  source_count INT, entity_count INT, tool_calls ARRAY<STRING>, claims ARRAY<STRING>,
  references ARRAY<STRING>, numbers ARRAY<STRING>, dates ARRAY<STRING>
"""

# One row per finding.  ``emit_seq``/``emit_idx`` keep the order in which one
# analyzer reports findings of the same rule; the type also holds order keys that
# are not positions.
EVIDENCE_COLUMNS = (
    ("run_id", "string"),
    ("analyzer_ord", "int"),
    ("emit_seq", "decimal(38,0)"),
    ("emit_idx", "int"),
    ("source", "string"),
    ("rule_id", "string"),
    ("rule_version", "string"),
    ("category", "string"),
    ("severity", "string"),
    ("description", "string"),
    ("rule_description", "string"),
    ("evidence_detail", "string"),
    ("value", "string"),
    ("agent", "string"),
    ("step", "bigint"),
    ("confidence", "double"),
)

RUN_COLUMNS = (
    ("run_id", "string"),
    ("workflow", "string"),
    ("timestamp", "timestamp"),
    ("status", "string"),
    ("total_latency_ms", "double"),
    ("total_tokens", "bigint"),
    ("schema_version", "string"),
    ("trace_path", "string"),
    ("trace_json", "string"),
    ("expected_output", "string"),
)

STEP_COLUMNS = (
    ("run_id", "string"),
    ("step", "bigint"),
    ("agent", "string"),
    ("status", "string"),
    ("latency_ms", "double"),
    ("tokens_prompt", "bigint"),
    ("tokens_completion", "bigint"),
    ("tokens_total", "bigint"),
    ("diff_summary", "string"),
    ("error", "string"),
    ("timestamp", "timestamp"),
    ("schema_version", "string"),
)

METRIC_COLUMNS = (
    ("run_id", "string"),
    ("step", "bigint"),
    ("agent", "string"),
    ("metric_name", "string"),
    ("metric_value", "double"),
    ("metric_unit", "string"),
    ("schema_version", "string"),
)

ANALYSIS_COLUMNS = (
    ("run_id", "string"),
    ("step", "bigint"),
    ("analyzer", "string"),
    ("category", "string"),
    ("verdict", "string"),
    ("confidence", "double"),
    ("details_json", "string"),
    ("schema_version", "string"),
)

DOCUMENT_COLUMNS = (
    ("run_id", "string"),
    ("first_pos", "bigint"),
    ("trace_json", "string"),
)

# Run totals and moments that streams keep up to date.
TOTAL_COLUMNS = (
    ("run_id", "string"),
    ("workflow", "string"),
    ("timestamp", "timestamp"),
    ("last_failure", "bigint"),
    ("last_error", "bigint"),
    ("last_step", "bigint"),
    ("total_latency_ms", "double"),
    ("total_tokens", "bigint"),
    ("step_count", "bigint"),
)

MOMENT_COLUMNS = (
    ("sign", "int"),
    ("runs_n", "bigint"),
    ("latency_ms_n", "bigint"),
    ("latency_ms_mean", "double"),
    ("latency_ms_m2", "double"),
    ("tokens_total_n", "bigint"),
    ("tokens_total_mean", "double"),
    ("tokens_total_m2", "double"),
)


def ddl(columns) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns)
