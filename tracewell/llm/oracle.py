"""The corpus queries in plain SQL."""

from __future__ import annotations

from tracewell.llm import cover_tree, hard_negatives, jaccard_join, secret_scan
from tracewell.llm.mixing import MOST_COPIES, SEED, WEIGHTS, offset
from tracewell.llm.url_filter import DEFAULT_VERDICT, RULES

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, {list(WEIGHTS)}[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)} + 1)::INT] AS w
  FROM sources
), summed AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
    coalesce(sum({MOST_COPIES} * source_size) OVER before, 0) AS used, coalesce(sum(w) OVER before, 0) AS passed
  FROM weighed
  WINDOW before AS (ORDER BY ({MOST_COPIES} * source_size)::DOUBLE / w::DOUBLE, source IS NULL, encode(source)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max((total - used)::DOUBLE / (weights - passed)::DOUBLE) AS share FROM summed
), targets AS (
  SELECT source, source_size, least(({MOST_COPIES} * source_size)::DOUBLE, share * w::DOUBLE) AS target FROM summed, level
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM sized
), rated AS (
  SELECT p.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(place::DOUBLE * rate + {offset(SEED)!r}::DOUBLE) - floor((place - 1)::DOUBLE * rate + {offset(SEED)!r}::DOUBLE))::BIGINT
    * size)::BIGINT AS taken
FROM rated
"""

_RULES = ", ".join(f"('{v}', '{r}')" for v, r in RULES)
URLS = f"""
WITH rules AS (
  SELECT verdict, rule, split_part(rule, '/', 1) AS rule_host, rule[length(split_part(rule, '/', 1)) + 1:] AS rule_path
  FROM (VALUES {_RULES}) v(verdict, rule)
), cut AS (
  SELECT page_id, row_number() OVER () AS row,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), best AS (
  SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row
)
SELECT page_id, host, path, b.rule, coalesce(b.verdict, '{DEFAULT_VERDICT}') AS verdict
FROM cut c LEFT JOIN best b ON c.row = b.row
"""



def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _places(kind: str, pattern: str, where: str = "true") -> str:
    """Matches of a pattern with their places: lengths of matches and of what is between."""
    return f"""
  SELECT row, '{kind}' AS kind, m, v, (before + list_sum(list_transform(gaps[:i], lambda g: length(g))))::BIGINT AS start
  FROM (
    SELECT row, gaps, i, ms[i] AS m, vs[i] AS v, coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS before
    FROM (
      SELECT row, regexp_extract_all(t, p) AS ms, {"regexp_extract_all(t, p, 2)" if kind == "assign" else "regexp_extract_all(t, p)"} AS vs,
        regexp_split_to_array(t, p) AS gaps, unnest(range(1, len(regexp_extract_all(t, p)) + 1)) AS i
      FROM (SELECT row, t, {_quoted(pattern)} AS p FROM texts) WHERE regexp_matches(t, p)
    )
  ) WHERE {where}"""


SECRETS = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), base AS (
  SELECT row, kind, start, start + length(m) AS stop FROM (
    {_places("assign", secret_scan.ASSIGN, f"length(v) >= {secret_scan.LEAST_VALUE}")}
    UNION ALL {_places("access", secret_scan.ACCESS)}
    UNION ALL {_places("hex", secret_scan.HEX)})
), weak AS (
  SELECT w.row, kind, start, start + length(m) AS stop FROM (
    {_places("random", secret_scan.RANDOM, "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')")}
    UNION ALL {_places("named", secret_scan.NAMED)}) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = w.row AND b.start < w.start + length(w.m) AND w.start < b.stop)
), other AS (
  SELECT row, kind, start, start + length(m) AS stop FROM (
    {_places("identifier", secret_scan.IDENTIFIER)} UNION ALL {_places("endpoint", secret_scan.ENDPOINT)})
), pairs AS (
  SELECT w.row, w.start AS w_start, w.stop AS w_stop, o.kind AS o_kind, o.start AS o_start, o.stop AS o_stop
  FROM weak w JOIN other o ON w.row = o.row
  WHERE greatest(w.start, o.start) - least(w.stop, o.stop) BETWEEN 0 AND {secret_scan.SCOPE}
    AND (w.kind = 'named' OR o.kind = 'identifier')
), spans AS (
  SELECT DISTINCT row, kind, start, stop FROM (
    SELECT * FROM base
    UNION ALL SELECT row, 'linked', w_start, w_stop FROM pairs
    UNION ALL SELECT row, 'identifier', o_start, o_stop FROM pairs WHERE o_kind = 'identifier')
), named AS (
  SELECT *, list_position({list(secret_scan.KINDS)}, kind) AS place, kind || ':' || start || ':' || stop AS said FROM spans
), joined AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(said, ',' ORDER BY start, place, stop) AS spans,
    string_agg(said, ',' ORDER BY start, place, stop) FILTER (place <= 3) AS base_spans
  FROM named GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN joined j ON t.row = j.row
"""

EMBEDDINGS = f"""
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {cover_tree.COSINE}
), reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM valid UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), least AS (
  SELECT vec_id, min(other) AS other FROM reached GROUP BY vec_id
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(other, e.vec_id)::BIGINT AS component_id,
  coalesce(coalesce(other, e.vec_id) = e.vec_id, false) AS kept
FROM embeddings e LEFT JOIN counted c ON e.vec_id = c.a LEFT JOIN least l ON e.vec_id = l.vec_id
"""

_G, _P = jaccard_join.GRAM, jaccard_join.SHARE
_RUN = " || ' ' || ".join(f"w[i + {k}]" for k in range(_G))
JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {_G} THEN list_distinct(list_transform(range(1, len(w) - {_G - 2}), lambda i: {_RUN}))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {_P} * (a.n + b.n - count(*))
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (
  SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(other, s.doc_id)::BIGINT AS component_id
FROM sets s LEFT JOIN least l ON s.doc_id = l.doc_id
"""


def _checksum(text: str) -> str:
    """CRC-32 of an ASCII text."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    codes = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


def _way(state: str, cost: str, edit: str, line: str | None = None, when: str = "true") -> str:
    lines = f"{state}.r" if line is None else f"list_append({state}.r, {line})"
    return f"CASE WHEN {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {lines}}} ELSE {{'c': 1000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]}} END"


def _stays(state: str, initial: str, role: str) -> str:
    """A row keeps its role or takes another."""
    kept = _way(state, "tr * 5", "K", "role || ':' || text", f"NOT must AND initial = '{initial}'")
    return kept if not role else f"{kept}, {_way(state, '(1 + tr * 5)', 'R', chr(39) + role + ':' + chr(39) + ' || text', 'NOT must')}"


_FIRST = "{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
_NONE = "{'c': 1000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
_INSERTED = f"""
    SELECT conv_id, pos, s0, s1, u, list_min([a0, {_way("u", "5", "I", "'assistant:'")}]) AS a FROM (
      SELECT conv_id, pos, s0, s1, a0, list_min([u0, {", ".join(_way(q, "5", "I", "'user:'") for q in ("s0", "s1", "a0"))}]) AS u FROM"""
_SPACES = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
CONVERSATIONS = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_checksum("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault
  FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, left(role, 1) AS initial,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    right(rtrim(text, {_SPACES}), 1) NOT IN ('.', '!', '?') AS open
  FROM hurt
), judged AS (
  SELECT *, blank OR nth > 1 AS must, (NOT blank AND nth = 1 AND open)::BIGINT AS tr,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND nth > 1) AS duplicate, sum(tr)::BIGINT AS truncated,
    count(*) FILTER (pos > 1 AND (earlier || initial) NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM judged GROUP BY conv_id
), walk AS (
  {_INSERTED} (SELECT conv_id, 0::BIGINT AS pos, {_FIRST} AS s0, {_NONE} AS s1, {_NONE} AS u0, {_NONE} AS a0 FROM counted))
  UNION ALL
  {_INSERTED} (
    SELECT w.conv_id, j.pos, {_way("w.s0", "2", "D")} AS s0, list_min([{_way("w.s1", "2", "D")}, {_stays("w.s0", "s", "")}]) AS s1,
      list_min([{_way("w.u", "2", "D")}, {", ".join(_stays(q, "u", "user") for q in ("w.s0", "w.s1", "w.a"))}]) AS u0,
      list_min([{_way("w.a", "2", "D")}, {_stays("w.u", "a", "assistant")}]) AS a0
    FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = w.pos + 1))
), ended AS (
  SELECT c.*, list_min([w.s0, w.a]) AS best FROM walk w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.n
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN ended e ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""

_H = hard_negatives
NEGATIVES = f"""
WITH taking AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({_H.SCALE} * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS s
  FROM taking a JOIN taking b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {_H.POSITIVES}
), found AS (
  SELECT p.a, p.b AS p, p.s AS ps, n.b AS n, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank
  FROM positives p JOIN scored n ON p.a = n.a AND NOT n.same AND {_H.LEAST} * p.s <= 100 * n.s AND 100 * n.s <= {_H.MOST} * p.s
)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM found WHERE rank <= {_H.NEGATIVES}
"""

ORACLES = {"op11_hard_negatives": NEGATIVES, "op12_conversation_repair": CONVERSATIONS, "op7_jaccard_join": JACCARD, "op5_embedding_dedup": EMBEDDINGS, "op9_secrets": SECRETS, "op1_mixing": MIXING, "op2_url_filter": URLS}
