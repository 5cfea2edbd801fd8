"""The catalogue's queries once more as plain SQL, for checking on small data.

The SQL is written from the definitions, not from the Spark plans: windows over
whole runs, one nested WITH per query.  It is meant for DuckDB.
"""

from __future__ import annotations

EV = """
ev AS (
  SELECT event_id, ts,
    'run_' || user_id || '_' || strftime(date_trunc('week', ts), '%Y%m%d') AS run_id,
    'wf_' || (user_id % 3) AS workflow,
    CASE event_type WHEN 'view' THEN 'researcher' WHEN 'click' THEN 'writer' WHEN 'purchase' THEN 'verifier'
                    WHEN 'signup' THEN 'router' ELSE 'tool' END AS agent,
    event_type = 'error' AS err,
    CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    round(value * 100) AS latency_ms
  FROM events),
st AS (
  SELECT *, k * 10 AS tok, CAST(floor(k * 10 / 3) AS BIGINT) AS tok_p,
    k * 10 - CAST(floor(k * 10 / 3) AS BIGINT) AS tok_c,
    row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS step,
    CAST(8 + CASE k % 25 WHEN 3 THEN -8 WHEN 4 THEN 2 ELSE 0 END AS INTEGER) AS src,
    CAST(10 + CASE k % 20 WHEN 0 THEN 5 WHEN 1 THEN -4 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS ent,
    CASE WHEN err AND (k % 10 = 1 OR k % 50 = 3) THEN 'tool_failure_v1'
         WHEN NOT err AND k % 40 = 0 THEN 'missing_tool_output_v1' END AS tool_rule
  FROM ev),
ru AS (
  SELECT run_id, workflow, min(ts) AS ts, sum(latency_ms) AS lat, CAST(sum(tok) AS BIGINT) AS tok, count(*) AS n,
    CASE WHEN bool_or(err) THEN 'ERROR' ELSE 'SUCCESS' END AS status
  FROM st GROUP BY run_id, workflow)
"""

BASE = """
recent AS (SELECT run_id FROM ru),
base AS (
  SELECT (SELECT count(*) FROM recent) AS n_runs, count(*) AS n_steps, avg(latency_ms) AS lm,
    stddev_samp(latency_ms) AS ls, avg(tok) AS tm, stddev_samp(tok) AS tsd
  FROM st WHERE run_id IN (SELECT run_id FROM recent))
"""

# last counts per role, first positions per required agent
PROFILE = """
prof AS (
  SELECT run_id,
    min(step) FILTER (agent = 'researcher') AS f0, min(step) FILTER (agent = 'writer') AS f1,
    min(step) FILTER (agent = 'verifier') AS f2,
    max(step) FILTER (agent = 'researcher') AS l0, max(step) FILTER (agent = 'writer') AS l1,
    max(step) FILTER (agent = 'verifier') AS l2
  FROM st GROUP BY run_id),
roles AS (
  SELECT p.*, r.src AS rs, r.ent AS re, r.k AS rk, w.src AS ws, w.ent AS we, w.k AS wk, v.ent AS ve
  FROM prof p
  LEFT JOIN st r ON r.run_id = p.run_id AND r.step = p.l0
  LEFT JOIN st w ON w.run_id = p.run_id AND w.step = p.l1
  LEFT JOIN st v ON v.run_id = p.run_id AND v.step = p.l2)
"""

LOSS = """
deltas AS (
  SELECT run_id, rs, ws, re, we, ws - rs AS ds, we - re AS de, {failed} AS failed, rk, wk
  FROM roles WHERE l0 IS NOT NULL AND l1 IS NOT NULL),
judged AS (
  SELECT *, CASE WHEN failed THEN 'PASS' WHEN ds <= -3 OR de <= -3 THEN 'FAIL' WHEN ds <> 0 OR de <> 0 THEN 'WARNING'
                 ELSE 'PASS' END AS verdict,
    (abs(ds) / greatest(rs, 1) + abs(de) / greatest(re, 1)) / 2.0 AS ratio
  FROM deltas),
loss AS (
  SELECT *,
    CASE WHEN failed THEN 0.0 WHEN verdict = 'FAIL' THEN round(least(0.99, greatest(0.80, 0.80 + ratio * 0.19)), 4)
         WHEN verdict = 'WARNING' THEN round(least(0.84, greatest(0.60, 0.60 + ratio * 0.24)), 4)
         ELSE 1.0 END::DOUBLE AS confidence
  FROM judged)
"""

EVIDENCE = """
evd AS (
  SELECT run_id, 'rule_engine' AS source, 2 AS rank, tool_rule AS rule_id, 'execution' AS category, 'high' AS severity,
    agent, step, 'FAIL' AS value, 1.0::DOUBLE AS confidence, 2 AS ord, step AS seq,
    CASE tool_rule WHEN 'tool_failure_v1' THEN 'Tool ''lookup'' returned an error.'
      ELSE 'Agent ''' || agent || ''' called tool ''lookup'' but no output was recorded.' END AS description
  FROM st WHERE tool_rule IS NOT NULL
  UNION ALL
  SELECT run_id, 'rule_engine', 2, 'researcher_quality_v1', 'reasoning', 'high', 'researcher', l0, 'FAIL', 1.0, 2, 0,
    'Researcher source count (' || rs || ') below threshold (1).' FROM roles WHERE rs < 1
  UNION ALL
  SELECT run_id, 'rule_engine', 2, 'hallucination_v1', 'reasoning', 'high', 'writer', l1, 'FAIL', 1.0, 2, 0,
    'Writer hallucinated entities (gain of ' || (we - re) || ').' FROM roles WHERE we - re > 0
  UNION ALL
  SELECT run_id, 'rule_engine', 2, 'verifier_passthrough_v1', 'verification', 'high', 'verifier', l2, 'FAIL', 1.0, 2, 0,
    'Verifier passed through hallucinated entities unchallenged.' FROM roles WHERE we = ve AND we - re > 0
  UNION ALL
  SELECT run_id, 'workflow_validator', 3, 'skipped_step_v1', 'workflow', 'high', a, NULL, 'FAIL', 1.0, 4, i,
    'Required agent ''' || a || ''' is missing from the trace.'
  FROM prof, (VALUES (0, 'researcher'), (1, 'writer'), (2, 'verifier')) q(i, a)
  WHERE CASE i WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END IS NULL
  UNION ALL
  SELECT run_id, 'workflow_validator', 3, 'wrong_order_v1', 'workflow', 'high', 'writer', f1, 'FAIL', 1.0, 4, 0,
    'Agent ''writer'' executed before ''researcher''.' FROM prof WHERE f1 < f0
  UNION ALL
  SELECT run_id, 'workflow_validator', 3, 'wrong_order_v1', 'workflow', 'high', 'verifier', f2, 'FAIL', 1.0, 4, 1,
    'Agent ''verifier'' executed before ''writer''.' FROM prof WHERE f2 < f1
  UNION ALL
  SELECT run_id, 'rule_engine', 2, 'information_loss_v1', CASE verdict WHEN 'FAIL' THEN 'workflow' ELSE 'reasoning' END,
    CASE verdict WHEN 'FAIL' THEN 'high' ELSE 'medium' END, 'writer', NULL, verdict, confidence, 3, 0,
    CASE verdict WHEN 'FAIL'
      THEN 'Information loss detected: sources or entities were dropped in the Researcher → Writer handoff. '
      ELSE 'Information gain detected: Writer introduced sources or entities not present in research findings (hallucination risk). '
    END || 'source: ' || rs || '→' || ws || ', entity: ' || re || '→' || we
  FROM loss WHERE verdict <> 'PASS' AND NOT failed),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank, rule_id, ord, seq) AS evidence_no FROM evd),
verd AS (
  SELECT r.run_id, b.rule_id AS deciding_rule, b.confidence, coalesce(c.n, 0) AS evidence_count,
    coalesce(b.category, 'unknown') AS primary_cause, 'P' || coalesce(b.rank, 5) AS priority_level,
    false AS grounded, b.agent AS primary_agent,
    CASE WHEN b.rank IS NULL THEN 'No evidence collected — P5 fallback.'
      ELSE CASE b.rank WHEN 2 THEN 'P2 rule match: ' ELSE 'P3 Workflow violation: ' END || b.rule_id ||
        ' (confidence=' || CAST(round_even(b.confidence * 100, 0) AS BIGINT) || '%)' END AS summary
  FROM (SELECT DISTINCT run_id FROM st) r
  LEFT JOIN numbered b ON b.run_id = r.run_id AND b.evidence_no = 1
  LEFT JOIN (SELECT run_id, count(*) AS n FROM evd GROUP BY run_id) c ON c.run_id = r.run_id),
told AS (
  SELECT *,
    '[Fallback — LLM unavailable] The ' || priority_level || ' analysis may indicate a ' || primary_cause ||
      ' issue attributed to ' || coalesce(primary_agent, 'an agent') || '. Rule ''' ||
      coalesce(deciding_rule, 'unknown rule') || ''' fired during the Arbiter evaluation.' AS words,
    CASE primary_cause
      WHEN 'reasoning' THEN 'Review ' || primary_agent || '''s output for hallucinated facts not present in the research.'
      WHEN 'workflow' THEN 'Check the handoff from the previous agent to ' || primary_agent || ' for dropped context.'
      WHEN 'execution' THEN 'Investigate ' || primary_agent || ' for tool errors, timeouts, or missing outputs.'
      WHEN 'verification' THEN 'Review the verifier''s approval criteria — it may have passed a flawed output.'
      ELSE 'Inspect the pipeline trace manually — no specific rule matched.' END AS fix
  FROM verd)
"""

RULES = EV + "," + PROFILE
LOSSES = RULES + "," + LOSS.format(failed="false")
VERDICTS = LOSSES + "," + EVIDENCE

# one finding per event of six kinds, in the order of a bundle
GIVEN = EV + """,
given AS (
  SELECT *, rn - 1 AS place FROM (
    SELECT run_id, agent, k / 1000 AS confidence, kind.*,
      coalesce(kind.rule, 'zzz') AS tie, CASE WHEN kind.rank <= 3 AND kind.source <> 'consistency_validator' THEN kind.rank ELSE 5 END AS eff,
      row_number() OVER (PARTITION BY run_id ORDER BY kind.rank, coalesce(kind.rule, 'zzz'), ts, event_id) AS rn, ts, event_id
    FROM st JOIN (VALUES (0, 'ground_truth', 'gt_mismatch_v1', 'verification', 1), (1, 'rule_engine', 'tool_failure_v1', 'execution', 2),
      (2, 'workflow_validator', 'wrong_order_v1', 'workflow', 3), (3, 'consistency_validator', NULL, 'reasoning', 3),
      (4, 'metrics_analyzer', NULL, 'execution', 4), (5, 'rule_engine', 'hallucination_v1', 'reasoning', 2)
      ) kind(no, source, rule, category, rank) ON k % 60 = kind.no)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY eff, tie, ts, event_id) AS b FROM given),
judged AS (
  SELECT r.run_id, CASE WHEN b.eff IS NULL OR b.eff = 5 THEN 'unknown' WHEN b.eff = 3 THEN 'workflow' ELSE b.category END AS primary_cause,
    'P' || coalesce(b.eff, 5) AS priority_level, coalesce(b.eff, 5) < 5 AS decided, b.agent, b.rule, b.confidence
  FROM ru r LEFT JOIN best b ON b.run_id = r.run_id AND b.b = 1)
"""

REASONS_BASE = """
reasons AS (
  SELECT st.*, list_filter([
    CASE WHEN latency_ms > 5000 THEN 'latency ' || CAST(latency_ms AS BIGINT) || 'ms > threshold 5000ms' END,
    CASE WHEN n_runs >= 5 AND ls > 0 AND latency_ms > lm + 2.5 * ls THEN 'latency ' || CAST(latency_ms AS BIGINT) ||
      'ms > statistical threshold (' || CAST(round_even(lm, 0) AS BIGINT) || ' + 2.5σ)' END,
    CASE WHEN n_runs >= 5 AND tsd > 0 AND tok > tm + 2.5 * tsd THEN 'tokens ' || tok ||
      ' > statistical threshold (' || CAST(round_even(tm, 0) AS BIGINT) || ' + 2.5σ)' END],
    lambda x: x IS NOT NULL) AS rs
  FROM st, base)
"""

CONV = """
cs AS (
  SELECT conv_id, 'conv_' || conv_id AS run_id, turn, turn + 1 AS step, role AS agent, text, length(text) AS size
  FROM conversations)
"""

DIFF = CONV + r"""
, lastt AS (
  SELECT conv_id, agent, min(turn) AS ord, arg_max(text, turn) AS text, max(turn) AS lt FROM cs GROUP BY conv_id, agent),
wordy AS (
  SELECT *, list_distinct(list_filter(
    string_split_regex(text, '[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'),
    lambda x: x <> '')) AS w FROM lastt),
compared AS (
  SELECT a.conv_id, 'conv_' || a.conv_id AS run_a, 'conv_' || (a.conv_id + 1) AS run_b, a.agent, a.ord,
    length(a.text)::DOUBLE AS lat_a, coalesce(length(b.text), 0)::DOUBLE AS lat_b,
    length(a.text) // 4 AS tok_a, coalesce(length(b.text) // 4, 0) AS tok_b,
    CASE WHEN b.text IS NULL THEN 0.0
      ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS sim
  FROM wordy a LEFT JOIN wordy b ON b.conv_id = a.conv_id + 1 AND b.agent = a.agent)
"""

LABELLED = """
lab AS (
  SELECT 'doc_' || doc_id AS run_id, doc_id,
    CASE WHEN toxic = 1 THEN 'reasoning_failure' WHEN quality = 1 THEN 'pass' ELSE 'execution_failure' END AS category,
    CASE WHEN toxic = 1 OR quality = 0 THEN 'researcher' END AS expected_agent
  FROM labels),
facts AS (
  SELECT lab.*, d.doc_id IS NOT NULL AND length(d.text) % 7 = 0 AS failing,
    d.doc_id IS NOT NULL AND NOT regexp_matches(d.text, '[0-9]') AS poor
  FROM lab LEFT JOIN documents d USING (doc_id)),
found AS (
  SELECT run_id, category, expected_agent, failing::INT + poor::INT AS findings,
    (category = 'execution_failure' AND failing) OR (category = 'reasoning_failure' AND poor) AS hit,
    CASE WHEN poor THEN 'reasoning' WHEN failing THEN 'execution' ELSE 'unknown' END AS cause,
    CASE WHEN failing OR poor THEN 'P2' ELSE 'P5' END AS level,
    CASE WHEN failing OR poor THEN 'researcher' END AS blamed
  FROM facts)
"""

STATES = """
shown AS (
  SELECT run_id, step, agent, turn, size, {
    'role': '"' || agent || '"', 'n_chars': size::VARCHAR,
    'n_lines': (len(string_split(text, chr(10))) - 1)::VARCHAR,
    'has_comma': CASE WHEN contains(text, ',') THEN 'true' ELSE 'false' END,
    'parity': '"' || (size % 2) || '"',
    'mark': CASE WHEN size % 3 = 0 THEN '""' ELSE '"' || upper(agent) || '"' END,
    'extra': CASE WHEN size % 5 = 0 THEN (size % 7)::VARCHAR END} AS s
  FROM cs),
members AS (
  SELECT b.run_id, b.step, unnest([
      {'key': 'extra', 'x': a.s.extra, 'y': coalesce(b.s.extra, a.s.extra)},
      {'key': 'has_comma', 'x': a.s.has_comma, 'y': b.s.has_comma},
      {'key': 'mark', 'x': a.s.mark, 'y': b.s.mark},
      {'key': 'n_chars', 'x': a.s.n_chars, 'y': b.s.n_chars},
      {'key': 'n_lines', 'x': a.s.n_lines, 'y': b.s.n_lines},
      {'key': 'parity', 'x': a.s.parity, 'y': b.s.parity},
      {'key': 'role', 'x': a.s.role, 'y': b.s.role}]) AS m
  FROM shown b JOIN shown a ON a.run_id = b.run_id AND a.turn = b.turn - 1),
content AS (
  SELECT run_id, step, m.key AS key,
    CASE WHEN m.x IN ('0', '""', 'false') THEN NULL ELSE m.x END AS x,
    CASE WHEN m.y IN ('0', '""', 'false') THEN NULL ELSE m.y END AS y
  FROM members),
lists AS (
  SELECT run_id, step,
    coalesce(list(key ORDER BY key) FILTER (x IS NULL AND y IS NOT NULL), []) AS a,
    coalesce(list(key ORDER BY key) FILTER (x <> y), []) AS m,
    coalesce(list(key ORDER BY key) FILTER (x = y), []) AS u,
    coalesce(list(key ORDER BY key) FILTER (x IS NOT NULL AND y IS NULL), []) AS d
  FROM content GROUP BY run_id, step)
"""


def _q(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()} {body}"


def _explorer(limit: str = "") -> str:
    return VERDICTS + f""",
    top AS (SELECT * FROM ru {limit}),
    tops AS (SELECT run_id, arg_min('topic ' || k, step) FILTER (k % 4 = 0) AS topic FROM st GROUP BY run_id),
    explored AS (
      SELECT top.run_id, top.workflow, coalesce(tops.topic, top.workflow) AS topic,
        strftime(top.ts, '%Y-%m-%d %H:%M:%S') AS timestamp, top.status, top.lat AS latency_ms, top.tok AS tokens_total,
        top.n AS step_count, v.primary_cause, v.priority_level, v.primary_agent,
        coalesce(loss.verdict, CASE WHEN v.priority_level = 'P5' THEN 'PASS' END, 'UNKNOWN') AS verdict
      FROM top LEFT JOIN tops USING (run_id) LEFT JOIN verd v USING (run_id) LEFT JOIN loss USING (run_id))"""


ORACLES = {
    "runs_rollup": _q(EV, """SELECT run_id, workflow, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, status,
        lat AS total_latency_ms, tok AS total_tokens, n AS step_count FROM ru"""),
    "list_runs_topn": _q(EV, """SELECT run_id, workflow, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM ru
        WHERE status = 'ERROR' AND workflow = 'wf_1' ORDER BY ts DESC, run_id LIMIT 25"""),
    "run_explorer": _q(_explorer("ORDER BY ts DESC, run_id LIMIT 50"), "SELECT * FROM explored"),
    "explorer_cards": _q(_explorer(), """SELECT count(*) AS total_runs, count(*) AS analyzed_runs,
        round(avg(latency_ms), 4) AS avg_latency_ms, CAST(sum(tokens_total) AS BIGINT) AS total_tokens,
        round(sum(tokens_total)::DOUBLE * 0.000005::DOUBLE, 6) AS cost_estimate,
        count(*) FILTER (verdict NOT IN ('PASS', 'UNKNOWN')) AS warnings FROM explored"""),
    "step_metrics": _q(EV, """SELECT run_id, step, agent, latency_ms, latency_ms > 5000 AS latency_flag,
        tok_p AS tokens_prompt, tok_c AS tokens_completion, tok AS tokens_total, latency_ms AS execution_time_ms,
        latency_ms > 5000 AS is_anomalous,
        CASE WHEN latency_ms > 5000 THEN 'latency ' || CAST(latency_ms AS BIGINT) || 'ms > threshold 5000ms' ELSE '' END AS reasons
        FROM st"""),
    "baseline_stats": _q(EV + "," + BASE, """SELECT n_runs >= 5 AND n_steps > 0 AS active, n_runs, n_steps,
        round(lm, 4) AS latency_mean, round(ls, 4) AS latency_std, round(tm, 4) AS token_mean, round(tsd, 4) AS token_std FROM base"""),
    "step_anomalies": _q(EV + "," + BASE + "," + REASONS_BASE,
        "SELECT run_id, step, agent, array_to_string(rs, '; ') AS reasons FROM reasons WHERE len(rs) > 0"),
    "slowest_fastest": _q(EV + """, o AS (SELECT *,
          row_number() OVER (PARTITION BY run_id ORDER BY latency_ms DESC, event_id) AS slow,
          row_number() OVER (PARTITION BY run_id ORDER BY latency_ms, event_id) AS fast FROM st)""",
        """SELECT run_id, workflow, sum(latency_ms) AS total_latency_ms, sum(latency_ms) AS total_execution_time_ms,
        CAST(sum(tok) AS BIGINT) AS total_tokens, count(*) AS step_count,
        count(*) FILTER (latency_ms > 5000) AS anomalous_count,
        max(agent) FILTER (slow = 1) AS slowest_step, max(agent) FILTER (fast = 1) AS fastest_step,
        bool_or(latency_ms > 5000) AS has_anomalies FROM o GROUP BY run_id, workflow"""),
    "agent_latency": _q(EV, "SELECT run_id, agent, arg_max(latency_ms, event_id) AS latency_ms FROM st GROUP BY run_id, agent"),
    "agent_summary": _q(EV, """SELECT agent, round(avg(latency_ms), 4) AS avg_latency_ms, max(latency_ms) AS max_latency_ms,
        round(avg(tok), 4) AS avg_tokens, CAST(sum(tok) AS BIGINT) AS total_tokens, count(*) AS run_count
        FROM st GROUP BY agent"""),
    "cost_estimate": _q(EV, """SELECT count(*) AS runs, CAST(sum(tok) AS BIGINT) AS total_tokens,
        round(sum(tok)::DOUBLE * 0.000005::DOUBLE, 6) AS cost_estimate FROM ru"""),
    "metrics_long": _q(EV, """SELECT run_id, step, agent, m.n AS metric_name, m.v AS metric_value, m.u AS metric_unit,
        '1.0' AS schema_version FROM (SELECT run_id, step, agent, unnest([
          {'n': 'latency_ms', 'v': latency_ms, 'u': 'ms'}, {'n': 'execution_time_ms', 'v': latency_ms, 'u': 'ms'},
          {'n': 'tokens_prompt', 'v': tok_p::DOUBLE, 'u': 'tokens'}, {'n': 'tokens_completion', 'v': tok_c::DOUBLE, 'u': 'tokens'},
          {'n': 'tokens_total', 'v': tok::DOUBLE, 'u': 'tokens'}]) AS m FROM st)"""),
    "step_share": _q(EV, """SELECT run_id, step, agent, latency_ms, max(latency_ms) OVER w AS max_latency_ms,
        sum(latency_ms) OVER w AS run_latency_ms, CAST(sum(tok) OVER w AS BIGINT) AS run_tokens, count(*) OVER w AS run_steps,
        round(CASE WHEN max(latency_ms) OVER w = 0 THEN 0.0 ELSE latency_ms / max(latency_ms) OVER w * 100 END, 4) AS latency_pct
        FROM st WINDOW w AS (PARTITION BY run_id)"""),
    "trace_timeline": _q(CONV, """SELECT run_id, step, agent,
        last_value(size) OVER (PARTITION BY run_id, agent ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS agent_state,
        count(*) OVER (PARTITION BY run_id) AS run_steps,
        round(size::DOUBLE / max(size) OVER (PARTITION BY run_id) * 100, 4) AS latency_pct FROM cs"""),
    "latest_run": _q(EV, """SELECT run_id, step, agent, latency_ms, tok AS tokens_total, latency_ms > 5000 AS latency_flag
        FROM st WHERE run_id = (SELECT run_id FROM ru ORDER BY ts DESC, run_id LIMIT 1)"""),
    "tool_rules": _q(VERDICTS, """SELECT run_id, rule_id, category, severity, agent, step, description, confidence
        FROM evd WHERE category = 'execution'"""),
    "evidence_rules": _q(VERDICTS, """SELECT run_id, rule_id, category, agent, step, description FROM evd
        WHERE rule_id IN ('researcher_quality_v1', 'hallucination_v1', 'verifier_passthrough_v1')"""),
    "latest_evidence": _q(EV, """SELECT run_id, agent, step, src AS source_count, ent AS entity_count FROM
        (SELECT *, row_number() OVER (PARTITION BY run_id, agent ORDER BY step DESC) AS back FROM st) WHERE back = 1"""),
    "skipped_steps": _q(VERDICTS, """SELECT run_id, rule_id, category, agent, description, seq::BIGINT AS emit_seq
        FROM evd WHERE rule_id = 'skipped_step_v1'"""),
    "wrong_order": _q(VERDICTS, """SELECT run_id, rule_id, category, agent, step, description, seq::BIGINT AS emit_seq
        FROM evd WHERE rule_id = 'wrong_order_v1'"""),
    "role_order": _q(CONV + """, f AS (SELECT run_id, min(step) FILTER (agent = 'system') AS f0,
          min(step) FILTER (agent = 'user') AS f1, min(step) FILTER (agent = 'assistant') AS f2 FROM cs GROUP BY run_id)""",
        """SELECT run_id, 'skipped_step_v1' AS rule_id, a AS agent, NULL::BIGINT AS step,
          'Required agent ''' || a || ''' is missing from the trace.' AS description
        FROM f, (VALUES (0, 'system'), (1, 'user'), (2, 'assistant')) q(i, a)
        WHERE CASE i WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END IS NULL
        UNION ALL SELECT run_id, 'wrong_order_v1', 'user', f1, 'Agent ''user'' executed before ''system''.' FROM f WHERE f1 < f0
        UNION ALL SELECT run_id, 'wrong_order_v1', 'assistant', f2, 'Agent ''assistant'' executed before ''user''.' FROM f WHERE f2 < f1"""),
    "information_loss": _q(RULES + "," + LOSS.format(failed="(rk % 97 = 5 OR wk % 97 = 5)") + """,
        parts AS (SELECT *, CASE WHEN ds < 0 THEN 'DROPPED' WHEN ds > 0 THEN 'ADDED' ELSE 'PRESERVED' END AS ss,
          CASE WHEN de < 0 THEN 'DROPPED' WHEN de > 0 THEN 'ADDED' ELSE 'PRESERVED' END AS es,
          CASE WHEN ds = 0 THEN 'NONE' WHEN abs(ds) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS sv,
          CASE WHEN de = 0 THEN 'NONE' WHEN abs(de) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS ev2 FROM loss)""",
        """SELECT run_id, 'information_loss_v1' AS rule_id, 'workflow' AS rule_category,
        CASE WHEN NOT failed THEN rs END AS up_sources, CASE WHEN NOT failed THEN ws END AS down_sources,
        CASE WHEN NOT failed THEN ds END AS sources_delta, CASE WHEN NOT failed THEN ss END AS sources_signal,
        CASE WHEN NOT failed THEN sv END AS sources_severity,
        CASE WHEN NOT failed THEN re END AS up_entities, CASE WHEN NOT failed THEN we END AS down_entities,
        CASE WHEN NOT failed THEN de END AS entities_delta, CASE WHEN NOT failed THEN es END AS entities_signal,
        CASE WHEN NOT failed THEN ev2 END AS entities_severity, verdict, confidence,
        CASE WHEN failed THEN 'Rule skipped — evidence extraction failed on one or both steps.'
          ELSE 'Verdict: ' || verdict || chr(10) || '  source_count: ' || rs || ' → ' || ws || ' (' || ss ||
            CASE WHEN ds = 0 THEN '' ELSE ' ' || abs(ds) || ', severity=' || sv END || ')' || chr(10) ||
            '  entity_count: ' || re || ' → ' || we || ' (' || es ||
            CASE WHEN de = 0 THEN '' ELSE ' ' || abs(de) || ', severity=' || ev2 END || ')' END AS summary,
        NOT failed AND (ds < 0 OR de < 0) AS has_information_loss, NOT failed AND (ds > 0 OR de > 0) AS has_information_gain,
        failed AS rule_failed,
        CASE WHEN failed THEN 'Researcher extraction_failed=' || CASE WHEN rk % 97 = 5 THEN 'True' ELSE 'False' END ||
          ', Writer extraction_failed=' || CASE WHEN wk % 97 = 5 THEN 'True' ELSE 'False' END END AS error_message FROM parts"""),
    "analyzer_status": _q(EV + """, known AS (SELECT run_id, 'x' AS e, true AS has FROM ru
          UNION ALL SELECT 'idle_' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, false FROM nation),
        s AS (SELECT run_id, a AS analyzer_id, CASE WHEN a = 'ground_truth_validator' THEN
            CASE WHEN e IS NULL THEN 'No expected_output present in trace.' WHEN NOT has THEN 'No steps present in trace.' ELSE '' END
            WHEN NOT has THEN 'No steps in trace' ELSE '' END AS skip_reason
          FROM known, (VALUES ('rule_engine'), ('workflow_validator'), ('ground_truth_validator')) q(a))""",
        "SELECT run_id, analyzer_id, skip_reason <> '' AS skipped, skip_reason FROM s"),
    "verdicts": _q(VERDICTS, """SELECT run_id, primary_cause, priority_level, grounded, primary_agent, summary, deciding_rule,
        confidence, deciding_rule AS first_rule, evidence_count, evidence_count AS rule_count FROM verd"""),
    "document_verdicts": _q(VERDICTS, """SELECT run_id, primary_cause, priority_level, grounded, primary_agent, summary, deciding_rule,
        confidence, deciding_rule AS first_rule, evidence_count, evidence_count AS rule_count FROM verd"""),
    "grounded_verdicts": _q(GIVEN, """SELECT j.run_id, primary_cause, priority_level,
        coalesce(bool_or(source = 'ground_truth'), false) AS grounded, CASE WHEN decided THEN any_value(j.agent) END AS primary_agent,
        CASE WHEN decided THEN any_value(j.rule) END AS deciding_rule, CASE WHEN decided THEN any_value(j.confidence) END AS confidence,
        arg_min(g.rule, g.rn) FILTER (g.rule IS NOT NULL) AS first_rule, count(g.run_id) AS evidence_count, count(g.rule) AS rule_count
        FROM judged j LEFT JOIN given g USING (run_id) GROUP BY j.run_id, primary_cause, priority_level, decided"""),
    "bundles": _q(GIVEN, """SELECT j.run_id, coalesce(place // 2, 0) AS part, any_value(priority_level) AS priority_level,
        coalesce(string_agg(source, ',' ORDER BY rn), '') AS sources, coalesce(string_agg(g.rule, ',' ORDER BY rn) FILTER (g.rule IS NOT NULL), '') AS rules
        FROM judged j LEFT JOIN given g USING (run_id) GROUP BY j.run_id, place // 2"""),
    "loss_verdicts": _q(LOSSES, """SELECT r.run_id, CASE WHEN l.run_id IS NULL THEN 'Missing researcher or writer step' END AS error,
        CASE WHEN l.run_id IS NULL THEN NULL WHEN verdict = 'FAIL' THEN 'workflow' WHEN verdict = 'WARNING' THEN 'reasoning' ELSE 'unknown' END AS primary_cause,
        CASE WHEN l.run_id IS NULL THEN NULL WHEN verdict = 'PASS' THEN 'P5' ELSE 'P2' END AS priority_level,
        CASE WHEN verdict <> 'PASS' THEN 'writer' END AS primary_agent,
        CASE WHEN l.run_id IS NULL THEN NULL WHEN verdict = 'PASS' THEN 'No evidence collected — P5 fallback.'
          ELSE 'P2 rule match: information_loss_v1 (confidence=' || CAST(round_even(confidence * 100, 0) AS BIGINT) || '%)' END AS summary,
        CASE WHEN l.run_id IS NULL THEN NULL WHEN verdict = 'PASS' THEN 0 ELSE 1 END::BIGINT AS evidence_count
        FROM ru r LEFT JOIN loss l ON l.run_id = r.run_id"""),
    "ordered_evidence": _q(VERDICTS, "SELECT run_id, evidence_no, rule_id, agent, step, value FROM numbered"),
    "fallback_explanation": _q(VERDICTS, "SELECT run_id, words AS summary, fix AS suggested_fix FROM told"),
    "prompt_table": _q(VERDICTS + """, blocks AS (SELECT run_id,
          string_agg('  [' || evidence_no || '] rule=' || rule_id || '  confidence=' || CAST(round_even(confidence * 100, 0) AS BIGINT) ||
            '%  description=' || description, chr(10) ORDER BY evidence_no) AS e,
          string_agg('  - rule_id=' || rule_id || '  category=' || category || '  severity=' || severity || '  agent=' || agent,
            chr(10) ORDER BY evidence_no) AS r FROM numbered GROUP BY run_id)""",
        """SELECT run_id, 0::BIGINT AS part, concat_ws(chr(10), 'ANALYSIS VERDICT', '════════════════',
          'run_id         : ' || run_id, 'primary_cause  : ' || primary_cause, 'priority_level : ' || priority_level,
          'primary_agent  : ' || coalesce(primary_agent, 'unknown'), 'grounded       : False',
          'evidence_count : ' || evidence_count, '', 'EVIDENCE RECORDS', '────────────────', coalesce(e, '  (none)'), '',
          'FIRED RULES', '────────────', coalesce(r, '  (none)'), '', 'HEDGING INSTRUCTION', '───────────────────',
          'grounded=False → Use HEDGED language (may indicate, suggests, possible).', '') AS prompt
        FROM verd LEFT JOIN blocks USING (run_id)"""),
    "verdict_report": _q(VERDICTS, """SELECT t.run_id, concat_ws(chr(10), '## Verdict', '**Run:** `' || t.run_id || '`',
          '**Verdict:** ' || coalesce(l.verdict, 'UNKNOWN') || ' (' || priority_level || ')',
          '**Cause:** ' || primary_cause, '**Agent:** ' || coalesce(primary_agent, 'N/A'),
          '**Confidence:** ' || coalesce(CAST(round_even(l.confidence * 100, 0) AS BIGINT) || '%', '—'), '**Grounded:** No', '',
          '### Root Cause', words, '', '### Suggested Fix', fix) AS report
        FROM told t LEFT JOIN loss l ON l.run_id = t.run_id"""),
    "coarse_verdicts": _q(VERDICTS, """SELECT v.run_id, priority_level,
        CASE WHEN priority_level = 'P5' THEN 'PASS' ELSE coalesce(l.verdict, 'WARNING') END AS verdict
        FROM verd v LEFT JOIN loss l ON l.run_id = v.run_id"""),
    "handoff_diff": _q(CONV + "," + STATES, """SELECT run_id, step, array_to_string(a, ',') AS added_keys,
        array_to_string(m, ',') AS modified_keys, array_to_string(u, ',') AS unchanged_keys, array_to_string(d, ',') AS dropped_keys,
        len(d) > 0 AS has_information_loss, len(m) > 0 AS has_mutations, len(a) + len(m) + len(d) AS total_changes,
        CASE WHEN len(a) + len(m) + len(d) = 0 THEN 'no changes' ELSE concat_ws(', ',
          CASE WHEN len(a) > 0 THEN 'added=[''' || array_to_string(a, ''', ''') || ''']' END,
          CASE WHEN len(m) > 0 THEN 'modified=[''' || array_to_string(m, ''', ''') || ''']' END,
          CASE WHEN len(d) > 0 THEN 'DROPPED=[''' || array_to_string(d, ''', ''') || ''']' END) END AS handoff_summary
        FROM lists"""),
    "normalized_steps": _q(EV, """SELECT run_id, step, step - 1 AS pos, agent,
        CASE WHEN k % 11 IN (0, 2) THEN 'SUCCESS' WHEN k % 11 = 1 THEN 'ERROR' ELSE status END AS status,
        CASE WHEN k % 13 = 0 THEN '1970-01-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp,
        tok AS tokens_total, CASE WHEN k % 3 = 0 THEN 'added=[''x'']' ELSE '' END AS diff_summary,
        CASE WHEN k % 7 <= 1 THEN 'k,topic' WHEN k % 7 = 2 THEN '' ELSE 'n,on,topic' END AS input_keys,
        CASE WHEN k % 7 = 3 THEN '' ELSE 'entity_count,source_count' END AS output_keys,
        CASE WHEN k % 7 <> 2 THEN k::VARCHAR END AS k_text, '1.0' AS schema_version FROM st"""),
    "topic": _q(CONV, """SELECT run_id, coalesce(arg_min('about ' || repeat(agent, 9), turn) FILTER (size % 3 = 0),
        CASE WHEN count(*) > 4 THEN 'opening' ELSE '' END) AS topic FROM cs GROUP BY run_id"""),
    "trace_roundtrip": _q(EV, """SELECT run_id, workflow, step - 1 AS pos, step, agent, latency_ms,
        CASE WHEN k % 17 = 0 THEN ' ' ELSE '{"source_count":' || src || ',"entity_count":' || ent || '}' END AS output FROM st"""),
    "extraction_parse": _q(EV + """, x AS (SELECT *, k % 17 = 0 AS blank, k % 19 = 0 AS junk, k % 19 = 2 AS bad FROM st)""",
        """SELECT run_id, event_id AS step, agent,
        CASE WHEN blank OR junk OR bad OR k % 19 = 1 THEN 0 ELSE src END AS source_count,
        CASE WHEN blank OR junk OR bad THEN 0 WHEN k % 19 = 1 THEN 3 ELSE ent END AS entity_count,
        blank OR junk OR bad AS extraction_failed,
        CASE WHEN blank THEN 'Empty output — nothing to extract' WHEN junk THEN 'JSONDecodeError: response is not a JSON object'
          WHEN bad THEN 'ValueError: counts must be whole numbers from 0 on' END AS error_message,
        CASE WHEN blank OR junk OR bad THEN 0 ELSE tok END AS token_cost,
        CASE WHEN blank OR k % 19 <= 2 THEN '' ELSE agent END AS tool_calls,
        CASE WHEN blank OR k % 19 <= 2 THEN '' ELSE k::VARCHAR END AS numbers FROM x"""),
    "extraction_cost": _q(EV, "SELECT agent, CAST(sum(tok_p) AS BIGINT) AS token_cost FROM st GROUP BY agent"),
    "structural_counts": """WITH d AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents),
        h AS (SELECT *, (n + 1) // 2 AS half, greatest(1, n - (n + 1) // 2) AS rest FROM d)
        SELECT 'doc_' || doc_id AS run_id,
          CAST(CASE WHEN doc_id % 3 <> 0 THEN half ELSE half + rest + (doc_id % 2 = 0)::INT END AS INTEGER) AS source_count,
          CAST(CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN rest ELSE 0 END AS INTEGER) AS entity_count,
          trim(text) = '' AS extraction_failed FROM h""",
    "field_lists": r"""WITH l AS (SELECT doc_id, text,
          regexp_extract_all(text, 'https?://[A-Za-z0-9./_%#?=&:~-]+') AS r,
          regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?%?') AS n,
          regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS d,
          list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS c
        FROM documents)
        SELECT 'doc_' || doc_id AS run_id,
          array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), '|') AS references,
          array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), '|') AS numbers,
          array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), '|') AS dates,
          CAST(len(c) AS INTEGER) AS n_claims, array_to_string(c, '|') AS claims FROM l""",
    "checker_approval": _q(CONV + """, t AS (SELECT run_id, step, size, trim(CASE size % 3 WHEN 0 THEN '  Approved. '
          WHEN 1 THEN 'NOT APPROVED ' ELSE '' END || text, chr(32) || chr(9) || chr(10) || chr(13)) AS res FROM cs)""",
        """SELECT run_id, step, size % 3 = 0 AS verified, CAST(length(res) AS INTEGER) AS n_result,
        CAST(CASE WHEN size % 3 = 0 THEN 0 ELSE length(res) END AS INTEGER) AS n_notes FROM t"""),
    "display_formats": _q(EV, """SELECT event_id, CASE WHEN latency_ms >= 1000
          THEN format('{:.1f}s', round_even(latency_ms / 1000, 1)) ELSE CAST(latency_ms AS BIGINT) || 'ms' END AS latency,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, least(100.0::DOUBLE, tok::DOUBLE / 640.0::DOUBLE * 100) AS pct, agent,
        CAST(length(run_id || agent) AS INTEGER) AS n_name FROM st"""),
    "run_diff": _q(DIFF, "SELECT run_a, run_b, agent, ord, lat_a, lat_b, tok_a, tok_b, round(sim, 6)::DOUBLE AS similarity FROM compared"),
    "first_divergence": _q(DIFF, """SELECT run_a, run_b, coalesce(arg_min(agent, ord) FILTER (sim < 0.85), '(none)') AS first_divergence,
        round(avg(sim), 6)::DOUBLE AS overall_similarity FROM compared GROUP BY run_a, run_b"""),
    "label_eval": _q(LABELLED, """SELECT category, count(*) AS runs, count(*) FILTER (findings > 0) AS runs_with_findings,
        count(*) FILTER (hit) AS runs_with_expected_rule, round(avg(hit::INT), 6) AS recall FROM found GROUP BY category"""),
    "label_confusion": _q(LABELLED, """SELECT category, cause AS primary_cause, level AS priority_level, count(*) AS runs,
        count(*) FILTER (expected_agent IS NOT DISTINCT FROM blamed) AS agent_matches FROM found GROUP BY ALL"""),
    "label_false_positives": _q(LABELLED, "SELECT run_id, findings::BIGINT AS findings FROM found WHERE category = 'pass' AND findings > 0"),
    "label_distribution": _q(LABELLED, "SELECT category, count(*) AS runs FROM lab GROUP BY category"),
    "quarantine": _q(EV, """SELECT event_id, concat_ws(',', CASE WHEN k % 10 = 3 OR k / 100 > 1 THEN 'confidence' END,
          CASE WHEN k % 25 = 3 THEN 'source_count' END, CASE WHEN k % 9 = 0 THEN 'status' END) AS violations FROM st
        WHERE k % 10 = 3 OR k % 25 = 3 OR k % 9 = 0"""),
    "table_counts": _q(EV, """SELECT 'runs' AS table_name, count(*) AS n_rows FROM ru
        UNION ALL SELECT 'steps', count(*) FROM st UNION ALL SELECT 'metrics', 5 * count(*) FROM st
        UNION ALL SELECT 'runs run_1*', count(*) FROM ru WHERE starts_with(run_id, 'run_1')"""),
    "upsert_latest": _q(EV, """SELECT run_id, step, agent, CASE WHEN agent = 'writer' THEN 'FAILURE' ELSE status END AS status,
        CASE WHEN agent = 'writer' THEN latency_ms + 1 ELSE latency_ms END AS latency_ms FROM st"""),
    "upsert_runs": _q(EV, """SELECT run_id, workflow, CASE WHEN workflow = 'wf_2' THEN 'SKIPPED' ELSE status END AS status,
        tok AS total_tokens FROM ru"""),
    "metrics_store": _q(EV, """SELECT m.n AS metric_name, m.u AS metric_unit, count(*) AS n_rows, sum(m.v) AS total FROM (SELECT unnest([
          {'n': 'latency_ms', 'v': latency_ms, 'u': 'ms'}, {'n': 'execution_time_ms', 'v': latency_ms, 'u': 'ms'},
          {'n': 'tokens_prompt', 'v': tok_p::DOUBLE, 'u': 'tokens'}, {'n': 'tokens_completion', 'v': tok_c::DOUBLE, 'u': 'tokens'},
          {'n': 'tokens_total', 'v': tok::DOUBLE, 'u': 'tokens'}]) AS m FROM st) GROUP BY m.n, m.u"""),
    "analysis_rows": _q(VERDICTS, """SELECT run_id, step, source AS analyzer, category, value AS verdict, confidence, rule_id, agent FROM evd"""),
    "stream_tokens": _q(EV, """SELECT run_id, event_id, agent, tok_p AS tokens_prompt, tok_c AS tokens_completion,
        tok AS tokens_total FROM st"""),
    "stream_flags": _q(EV + "," + BASE, """SELECT run_id, event_id, agent, latency_ms, latency_ms > 5000 AS latency_flag,
        n_runs >= 5 AND ls > 0 AND latency_ms > lm + 2.5 * ls AS statistical_flag FROM st, base
        WHERE latency_ms > 5000 OR (n_runs >= 5 AND ls > 0 AND latency_ms > lm + 2.5 * ls)"""),
    "stream_upsert": _q(EV, """SELECT agent, status, count(*) AS n_steps, CAST(sum(tok) AS BIGINT) AS tokens_total,
        max(event_id) AS last_step FROM st GROUP BY agent, status"""),
    "step_events": _q(EV, """SELECT run_id, event_id AS step, agent, CASE WHEN err THEN '' ELSE 'done' END AS raw_output, status,
        CASE WHEN err THEN 'TimeoutError: after ' || k END AS error, tok AS tokens_total,
        CASE WHEN err THEN 'no changes' WHEN k = 0 THEN 'added=[''by'', ''n'']' ELSE 'added=[''by''], modified=[''n'']' END AS diff_summary
        FROM st"""),
}
ORACLES["stream_runs"] = ORACLES["runs_rollup"]
