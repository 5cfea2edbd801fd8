"""The store queries once more as plain SQL."""

from __future__ import annotations

from tracewell.plans.oracle_sql import EV

LAST = "(SELECT max(run_id) FROM ru)"
NOW = "now AS (SELECT *, CASE WHEN agent = 'writer' THEN 'FAILURE' ELSE status END AS s, latency_ms + CASE WHEN agent = 'writer' THEN 1 ELSE 0 END AS l FROM st)"
AGAIN = "again AS (SELECT *, CASE WHEN k % 25 = 2 THEN 'FAILURE' ELSE status END AS s, latency_ms + CASE WHEN k % 25 = 2 THEN 1 ELSE 0 END AS l, ts + CASE WHEN k % 25 = 2 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS t FROM st)"

STORED_ORACLES = {
    "stored_run": f"WITH {EV} SELECT run_id, workflow, CASE WHEN workflow = 'wf_2' THEN 'SKIPPED' ELSE status END AS status, tok AS total_tokens," + """
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN workflow <> 'wf_0' THEN '/traces/' || run_id || '.json' END AS trace_path,
        CASE WHEN workflow <> 'wf_0' THEN 'expected of ' || run_id END AS expected_output FROM ru WHERE run_id = """ + LAST,
    "stored_steps": f"WITH {EV}, {NOW} SELECT step, agent, s AS status, l AS latency_ms, tok_p AS tokens_prompt, tok_c AS tokens_completion, tok AS tokens_total FROM now WHERE run_id = {LAST}",
    "stored_metrics": f"WITH {EV}, {NOW}" + """ SELECT run_id, step, agent, m.n AS metric_name, m.v AS metric_value, m.u AS metric_unit FROM (SELECT run_id, step, agent, unnest([
          {'n': 'latency_ms', 'v': l, 'u': 'ms'}, {'n': 'execution_time_ms', 'v': l, 'u': 'ms'},
          {'n': 'tokens_prompt', 'v': tok_p::DOUBLE, 'u': 'tokens'}, {'n': 'tokens_completion', 'v': tok_c::DOUBLE, 'u': 'tokens'},
          {'n': 'tokens_total', 'v': tok::DOUBLE, 'u': 'tokens'}]) AS m FROM now) WHERE run_id = """ + LAST,
    "stored_trace_steps": f"WITH {EV} SELECT run_id, workflow, step - 1 AS pos, step, agent, latency_ms, agent AS output FROM st WHERE workflow <> 'wf_0'",
    "compacted_store": f"WITH {EV}, {NOW} SELECT agent, s AS status, count(*) AS n_steps, sum(l) AS latency_ms, count(DISTINCT run_id) AS n_runs FROM now GROUP BY agent, s",
    "migrated_runs": f"WITH {EV}" + """ SELECT run_id, workflow, tok + CASE WHEN workflow <> 'wf_0' THEN 1099511627776 ELSE 0 END AS total_tokens,
        CASE WHEN workflow <> 'wf_0' THEN status END AS status FROM ru""",
    "label_file": """SELECT 'doc_' || doc_id AS run_id, CASE WHEN toxic = 1 THEN 'reasoning_failure' WHEN quality = 1 THEN 'pass' ELSE 'execution_failure' END AS category,
        quality = 1 AS frozen FROM labels""",
    "largest_trace": f"WITH {EV} SELECT workflow, 10 * count(*) AS file_size FROM st WHERE k % 20 = 0 GROUP BY workflow ORDER BY 2 DESC, 1 LIMIT 1",
    "json_values": f"WITH {EV}" + """ SELECT event_id, CASE k % 5 WHEN 0 THEN '{"a":[' || k || '],"b":1}' WHEN 1 THEN '[1,2.5,null]' WHEN 2 THEN '"{broken"'
        WHEN 3 THEN '"7"' ELSE '"say \\"x\\""' END AS json FROM st""",
    "incremental_runs": f"WITH {EV}, {AGAIN}" + """ SELECT run_id, min(workflow) AS workflow, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS timestamp,
        coalesce(arg_max(s, event_id) FILTER (s <> 'SUCCESS'), 'SUCCESS') AS status, sum(l) AS total_latency_ms, sum(tok)::BIGINT AS total_tokens, count(*) AS step_count
        FROM again GROUP BY run_id""",
    "incremental_baseline": f"WITH {EV}, {AGAIN}" + """ SELECT count(DISTINCT run_id) >= 5 AS active, count(DISTINCT run_id) AS n_runs, count(*) AS n_steps,
        round(avg(l), 6) AS latency_mean, round(stddev_samp(l), 6) AS latency_std, round(avg(tok), 6) AS token_mean, round(stddev_samp(tok), 6) AS token_std FROM again""",
    "pending_tokens": f"WITH {EV}" + """ SELECT run_id, event_id AS step, agent, CASE WHEN k % 13 = 0 THEN 0 ELSE tok_p END AS tokens_prompt,
        CASE WHEN k % 13 = 0 THEN 0 WHEN k % 25 = 2 THEN tok_c + 1 ELSE tok_c END AS tokens_completion,
        CASE WHEN k % 13 = 0 THEN 0 WHEN k % 25 = 2 THEN tok + 1 ELSE tok END AS tokens_total FROM st""",
}
