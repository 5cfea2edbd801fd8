"""The check queries once more as plain SQL."""

from __future__ import annotations

from tracewell.operators.checks import LEAST_CHECK, WINDOW
from tracewell.plans.oracle_sql import BASE, EV, RULES

TURNS = """
turns AS (
  SELECT conv_id, 'conv_' || conv_id AS run_id, turn AS pos, turn + 1 AS step, role AS agent, text, length(text) AS size FROM conversations)
"""

LINKS = TURNS + """,
lk AS (
  SELECT run_id, step, CASE WHEN conv_id % 10 = 3 AND step = 3 THEN 99 WHEN conv_id % 10 = 4 AND step = 2 THEN 4
      WHEN conv_id % 10 = 5 AND step = 3 THEN NULL WHEN step > 1 THEN step - 1 END AS parent,
    CASE WHEN conv_id % 10 = 6 AND step = 2 THEN 50 ELSE step + 1 END AS child FROM turns),
tied AS (
  SELECT l.*, p.step IS NOT NULL AS has_parent, p.child AS named, c.step IS NOT NULL AS has_child,
    min(l.step) OVER (PARTITION BY l.run_id) AS first, max(l.step) OVER (PARTITION BY l.run_id) AS last, count(*) OVER (PARTITION BY l.run_id) AS n
  FROM lk l LEFT JOIN lk p ON p.run_id = l.run_id AND p.step = l.parent LEFT JOIN lk c ON c.run_id = l.run_id AND c.step = l.child),
walk AS (
  SELECT run_id, step, step AS at, 0::BIGINT AS hops FROM tied
  UNION ALL
  SELECT w.run_id, w.step, t.parent, w.hops + 1 FROM walk w JOIN tied t ON t.run_id = w.run_id AND t.step = w.at
  WHERE t.has_parent AND w.hops < t.n),
ends AS (
  SELECT w.run_id, w.step, w.at, w.hops, CASE WHEN t.parent IS NOT NULL THEN 'missing' WHEN t.step = t.first THEN 'root' ELSE 'orphan' END AS chain
  FROM walk w JOIN tied t ON t.run_id = w.run_id AND t.step = w.at WHERE NOT t.has_parent)
"""

STATES = TURNS + """,
members AS (
  SELECT run_id, pos, agent, unnest([
    {'k': 'role', 'v': agent}, {'k': 'n_chars', 'v': CASE WHEN size > 0 THEN size::VARCHAR END},
    {'k': 'n_lines', 'v': nullif(len(string_split(text, chr(10))) - 1, 0)::VARCHAR}, {'k': 'has_comma', 'v': CASE WHEN contains(text, ',') THEN 'true' END},
    {'k': 'parity', 'v': (size % 2)::VARCHAR}, {'k': 'mark', 'v': CASE WHEN size % 3 <> 0 THEN upper(agent) END},
    {'k': 'extra', 'v': CASE WHEN size % 5 = 0 AND size % 7 <> 0 THEN (size % 7)::VARCHAR END}]) AS m
  FROM turns),
filled AS (SELECT run_id, pos, m.k AS k, m.v AS v FROM members WHERE m.v IS NOT NULL),
handed AS (
  SELECT t.run_id, t.pos, t.step, t.agent, n.agent AS next_agent FROM turns t JOIN turns p ON p.run_id = t.run_id AND p.pos = t.pos - 1
  JOIN turns n ON n.run_id = t.run_id AND n.pos = t.pos + 1),
needs(agent, k) AS (VALUES ('user', 'extra'), ('user', 'mark'), ('assistant', 'has_comma'), ('assistant', 'n_lines'))
"""

VECTORS = """
vec AS (
  SELECT vec_id // 8 AS g, 'agent_' || (label % 3) AS agent, vec_id % 8 AS pos,
    CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE)
      WHEN vec_id % 17 = 0 THEN embedding[1:5]::DOUBLE[] WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda x: x::DOUBLE + 0.3)
      ELSE embedding::DOUBLE[] END AS v
  FROM embeddings),
ends AS (SELECT g, agent, min(pos) AS ord, arg_max({'v': v}, pos).v AS v FROM vec GROUP BY g, agent),
sided AS (
  SELECT 'emb_' || a.g AS run_a, 'emb_' || (a.g + 1) AS run_b, a.agent, a.ord, a.v AS va, b.v AS vb
  FROM ends a LEFT JOIN ends b ON b.g = a.g + 1 AND b.agent = a.agent),
reasoned AS (
  SELECT *, CASE WHEN va IS NULL OR vb IS NULL THEN 'missing' WHEN len(va) <> len(vb) THEN 'length'
    WHEN list_max(list_transform(va, lambda x: abs(x))) = 0 OR list_max(list_transform(vb, lambda x: abs(x))) = 0 THEN 'zero' END AS reason
  FROM sided),
compared AS (
  SELECT *, CASE WHEN reason IS NULL THEN list_dot_product(va, vb) / (sqrt(list_dot_product(va, va)) * sqrt(list_dot_product(vb, vb))) ELSE 0.0 END AS similarity
  FROM reasoned)
"""

CHECK_ORACLES = {
    "step_checks": f"WITH {EV}, x AS (SELECT event_id, run_id, agent, status, CASE WHEN k % 50 = 9 THEN 0.0 ELSE latency_ms END AS lat," + """
        CASE WHEN k % 40 = 0 THEN '' WHEN k % 30 = 7 THEN 'ok' ELSE 'a longer answer about ' || k END AS output FROM st)
      SELECT event_id, run_id, agent, 'failed_step' AS "check" FROM x WHERE status IN ('FAILURE', 'ERROR')
      UNION ALL SELECT event_id, run_id, agent, 'silent_failure' FROM x WHERE status = 'SUCCESS' AND output = ''
      UNION ALL SELECT event_id, run_id, agent, 'suspiciously_fast' FROM x WHERE lat = 0 AND output <> ''
      UNION ALL SELECT event_id, run_id, agent, 'trivial_check' FROM x WHERE agent = 'verifier' AND output <> '' """ + f"AND length(output) < {LEAST_CHECK}",
    "step_chains": f"WITH RECURSIVE {LINKS}" + """
      SELECT t.run_id, t.step, coalesce(e.chain, 'cycle') AS chain, e.at::BIGINT AS end_step, e.hops, has_parent AND named IS DISTINCT FROM t.step AS unlinked,
        t.child IS NOT NULL AND NOT has_child AND t.step <> t.last AS dangling
      FROM tied t LEFT JOIN ends e ON e.run_id = t.run_id AND e.step = t.step""",
    "approval_streaks": f"WITH {EV}" + """, c AS (SELECT run_id, workflow, min(ts) AS ts, bool_and(k % 4 <> 0) AS approved FROM st WHERE agent = 'verifier' GROUP BY run_id, workflow)
      SELECT run_id, workflow, approved, count(*) OVER w AS window_runs, (count(*) FILTER (NOT approved) OVER w)::BIGINT AS rejections, """ + f"""
        count(*) OVER w = {WINDOW} AND count(*) FILTER (NOT approved) OVER w = 0 AS always_approves
      FROM c WINDOW w AS (PARTITION BY workflow ORDER BY ts, run_id ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)""",
    "circular_checks": f"WITH {TURNS}" + """, own AS (
        SELECT t.run_id, t.pos, s.text AS given, lag(t.text) OVER w AS before, lag(t.pos) OVER w AS previous_pos
        FROM turns t LEFT JOIN turns s ON s.run_id = t.run_id AND s.pos = t.pos - CASE WHEN t.conv_id % 7 = 2 THEN 2 ELSE 1 END
        WHERE t.agent = 'assistant' WINDOW w AS (PARTITION BY t.run_id ORDER BY t.pos))
      SELECT run_id, pos, previous_pos FROM own WHERE given <> '' AND given = before""",
    "handoff_contracts": f"WITH {STATES}" + """
      SELECT h.run_id, h.step, h.agent, h.next_agent,
        coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM needs n WHERE n.agent = h.next_agent
          AND NOT EXISTS (SELECT 1 FROM filled f WHERE f.run_id = h.run_id AND f.pos = h.pos AND f.k = n.k)), '') AS missing_keys,
        coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM filled b WHERE b.run_id = h.run_id AND b.pos = h.pos - 1
          AND NOT EXISTS (SELECT 1 FROM filled f WHERE f.run_id = h.run_id AND f.pos = h.pos AND f.k = b.k)), '') AS dropped_keys,
        CASE WHEN h.pos % 4 = 0 THEN '' ELSE coalesce((SELECT string_agg(b.k, ',' ORDER BY b.k) FROM filled b JOIN filled f
          ON f.run_id = b.run_id AND f.pos = b.pos + 1 AND f.k = b.k AND f.v <> b.v WHERE b.run_id = h.run_id AND b.pos = h.pos - 1), '') END AS mutated_keys,
        (SELECT count(*) FROM filled f WHERE f.run_id = h.run_id AND f.pos = h.pos) < (SELECT count(*) FROM filled b WHERE b.run_id = h.run_id AND b.pos = h.pos - 1) AS shrunk
      FROM handed h""",
    "embedding_diff": f"WITH {VECTORS} SELECT run_a, run_b, agent, ord, round(similarity, 6) AS similarity, reason FROM compared",
    "embedding_divergence": f"WITH {VECTORS}" + """ SELECT run_a, run_b, coalesce(arg_min(agent, ord) FILTER (similarity < 0.85), '(none)') AS first_divergence,
        round(avg(similarity), 6) AS overall_similarity FROM compared GROUP BY run_a, run_b""",
    "anomaly_verdicts": f"WITH {EV}, {BASE}" + """, hits AS (
        SELECT run_id, count(*) AS n FROM st, base WHERE latency_ms > 5000 OR (n_runs >= 5 AND ls > 0 AND latency_ms > lm + 2.5 * ls)
          OR (n_runs >= 5 AND tsd > 0 AND tok > tm + 2.5 * tsd) GROUP BY run_id)
      SELECT r.run_id, 'unknown' AS primary_cause, 'P5' AS priority_level, NULL::VARCHAR AS primary_agent, coalesce(h.n, 0)::BIGINT AS evidence_count
      FROM ru r LEFT JOIN hits h ON h.run_id = r.run_id""",
    "analysis_status": f"WITH {RULES}" + """, known AS (
        SELECT r.run_id, r.n, p.l0, p.l1, (p.rk % 97 = 5) AS up_failed, (p.wk % 97 = 5) AS down_failed FROM ru r JOIN roles p ON p.run_id = r.run_id
        UNION ALL SELECT 'idle_' || n_nationkey, 0, NULL, NULL, NULL, NULL FROM nation),
      reasoned AS (
        SELECT k.*, a AS analyzer_id, CASE WHEN a = 'raises' THEN 'LookupError: no such agent' WHEN a = 'breaks' THEN 'SparkRuntimeException: USER_RAISED_EXCEPTION'
          WHEN a = 'picky' THEN CASE WHEN n < 5 THEN 'Too few steps' END
          WHEN a = 'careless' THEN NULL WHEN n = 0 THEN 'No steps in trace'
          WHEN a = 'information_loss' AND (l0 IS NULL OR l1 IS NULL) THEN 'Missing researcher or writer step'
          WHEN a = 'information_loss' AND (up_failed OR down_failed) THEN 'Extraction failed' END AS reason
        FROM known k, (VALUES ('tool_calls'), ('counts'), ('information_loss'), ('workflow'), ('raises'), ('breaks'), ('careless'), ('picky')) q(a)),
      refused AS (SELECT run_id, 'careless' AS analyzer_id, count(*) AS c FROM st WHERE k = 3 GROUP BY run_id)
      SELECT r.run_id, r.analyzer_id, CASE WHEN reason IS NOT NULL AND r.analyzer_id IN ('raises', 'breaks') THEN 'failed' WHEN reason IS NOT NULL THEN 'skipped'
          WHEN c IS NOT NULL THEN 'refused' ELSE 'ok' END AS status, coalesce(reason, c || ' findings refused: confidence', '') AS reason
      FROM reasoned r LEFT JOIN refused f ON f.run_id = r.run_id AND f.analyzer_id = r.analyzer_id""",
    "guarded_evidence": f"WITH {RULES}" + """ SELECT 'own_v1' AS rule_id, count(*) AS findings FROM st WHERE k IN (4, 5)
      UNION ALL SELECT 'tool_failure_v1', count(*) FROM st WHERE tool_rule = 'tool_failure_v1'
      UNION ALL SELECT 'skipped_step_v1', (SELECT sum((f0 IS NULL)::INT + (f1 IS NULL)::INT + (f2 IS NULL)::INT)::BIGINT FROM prof)""",
}
