"""Twenty labelled runs, built from their counts.

Each entry: category, upstream (sources, entities), downstream (sources, entities),
tool calls of the upstream step, agent left out.
"""

from __future__ import annotations

import json

_TIMEOUT = {"name": "web_search", "args": {"q": "x"}, "result": None, "error": "TimeoutError: no answer"}
_SILENT = {"name": "weather_api", "args": {}, "result": "", "error": None}
_AUTH = {"name": "crypto_api", "args": {"coin": "BTC"}, "result": None, "error": "AuthError: Invalid API key"}
_NONE = {"name": "sports_api", "args": {}, "result": None, "error": None}

# Counts, categories and tool calls of the labelled runs.
RUNS = {
    "pass_01": ("pass", (8, 10), (8, 10), [], None),
    "pass_02": ("pass", (7, 9), (7, 9), [], None),
    "pass_03": ("pass", (4, 6), (4, 6), [], None),
    "pass_04": ("pass", (12, 18), (12, 18), [], None),
    "reasoning_01": ("reasoning_failure", (8, 10), (11, 24), [], None),
    "reasoning_02": ("reasoning_failure", (6, 8), (10, 18), [], None),
    "reasoning_03": ("reasoning_failure", (5, 7), (8, 15), [], None),
    "reasoning_04": ("reasoning_failure", (7, 9), (11, 20), [], None),
    "execution_01": ("execution_failure", (0, 0), (0, 0), [_TIMEOUT], "verifier"),
    "execution_02": ("execution_failure", (0, 1), (0, 1), [_SILENT], "verifier"),
    "execution_03": ("execution_failure", (0, 0), (0, 0), [_AUTH, _AUTH], "verifier"),
    "execution_04": ("execution_failure", (2, 3), (2, 3), [_NONE], "verifier"),
    "workflow_01": ("workflow_failure", (8, 10), (8, 10), [], "verifier"),
    "workflow_02": ("workflow_failure", (10, 14), (10, 14), [], "verifier"),
    "workflow_03": ("workflow_failure", (0, 0), (5, 8), [], "researcher"),
    "workflow_04": ("workflow_failure", (6, 9), (6, 9), [], "verifier"),
    "verification_01": ("verification_failure", (6, 8), (9, 20), [], None),
    "verification_02": ("verification_failure", (5, 7), (8, 22), [], None),
    "verification_03": ("verification_failure", (7, 10), (12, 25), [], None),
    "verification_04": ("verification_failure", (4, 6), (11, 18), [], None),
}

# Confidence of the information-loss warning; other runs pass, workflow_03 has no pair
WARNINGS = {
    "reasoning_01": 0.813, "reasoning_02": 0.83, "reasoning_03": 0.8091, "reasoning_04": 0.8152,
    "verification_01": 0.84, "verification_02": 0.84, "verification_03": 0.84, "verification_04": 0.84,
}
AGENT_OF = {"workflow_03": "researcher"}


def document(name: str) -> dict:
    category, up, down, calls, missing = RUNS[name]
    topic = f"topic of {name}"
    state = {"topic": topic, "research_findings": "", "source_count": 0, "entity_count": 0, "verified": False}
    counts = {"researcher": up, "writer": down, "verifier": down}
    field = {"researcher": "research_findings", "writer": "written_report", "verifier": "verification_result"}
    steps = []
    for agent, latency in (("researcher", 310.0), ("writer", 470.0), ("verifier", 90.0)):
        if agent == missing:
            continue
        sources, entities = counts[agent]
        returned = {"source_count": sources, "entity_count": entities, field[agent]: f"{agent} text"}
        number = len(steps) + 1
        steps.append(
            {
                "schema_version": "1.0", "run_id": f"run_lbl_{name}", "step": number, "agent": agent, "node_type": "llm",
                "input": json.dumps(state), "output": json.dumps(returned), "expected_output": None,
                "prompt": f"added=['{field[agent]}']", "system_prompt": "", "model": "m",
                "generation_params": {"temperature": 0.7, "top_p": 0.9, "max_tokens": 64, "seed": 11},
                "latency_ms": latency, "tokens": {"prompt": 31, "completion": 12, "total": 43},
                "tool_calls": calls if agent == "researcher" else [],
                "handoff": {"input_state": state, "filtered_state": returned, "output_state": {**state, **returned}},
                "parent_step": number - 1 or None, "child_step": number + 1,
                "status": "ERROR" if calls and agent == "researcher" else "SUCCESS", "error": None,
                "timestamp": f"2026-01-01T00:00:0{number}+00:00",
            }
        )
        state = {**state, **returned}
    return {
        "schema_version": "1.0", "run_id": f"run_lbl_{name}", "workflow": "research_report_pipeline",
        "timestamp": "2026-01-01T00:00:00+00:00", "steps": steps,
        "total_latency_ms": sum(s["latency_ms"] for s in steps), "total_tokens": sum(s["tokens"]["total"] for s in steps),
    }


def write_corpus(folder) -> str:
    """One pretty-printed file per run, and the labels; returns the traces folder."""
    traces = folder / "traces"
    traces.mkdir()
    for name in RUNS:
        (traces / f"run_lbl_{name}.json").write_text(json.dumps(document(name), indent=2))
    labels = [
        {
            "run_id": f"run_lbl_{name}", "label_id": f"lbl_{name}", "category": category,
            "expected_primary_agent": None if category == "pass" else {
                "reasoning_failure": "writer", "execution_failure": "researcher",
                "verification_failure": "verifier"}.get(category, missing),
            "researcher_sources": up[0], "skip_step": missing, "frozen": True,
        }
        for name, (category, up, _, _, missing) in RUNS.items()
    ]
    (folder / "labels.json").write_text(json.dumps({"version": "1.0.0", "total": 20, "frozen": True, "runs": labels}, indent=2))
    return str(traces)
