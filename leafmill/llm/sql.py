"""DuckDB equivalents of the queries that SQL can express on whole tables."""

from __future__ import annotations

P2_FOUND = "SELECT id AS page_id FROM pages WHERE length(raw_text) > 4000"

P3_FOUND = r"""
WITH m AS (
  SELECT session_id, id, content, created_at,
         CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'bot', 'ai') THEN 'assistant' WHEN r = 'system' THEN 'system' END AS role
  FROM (SELECT *, lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) AS r FROM session_messages)
),
rows AS (SELECT * FROM m WHERE role IS NULL OR role <> 'system' OR created_at IS NULL),
marked AS (
  SELECT *, created_at - lag(created_at) OVER (PARTITION BY session_id, role, content ORDER BY created_at, id) <= INTERVAL 5 SECOND AS again,
         NOT coalesce(regexp_matches(regexp_replace(content, '<think>.*?(</think>|$)', '', 'gs'), '[^\p{Z}\p{C}\s]'), false) AS blank
  FROM rows
),
turns AS (
  SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY session_id ORDER BY created_at, id) AS turn
  FROM marked WHERE again IS NOT TRUE
),
per_turn AS (
  SELECT session_id, turn, bool_or(role IS NULL OR created_at IS NULL) AS broken, bool_or(role = 'user' AND blank) AS empty,
         bool_or(role = 'assistant' AND NOT blank) AS answered
  FROM turns GROUP BY session_id, turn
),
kept AS (
  SELECT session_id FROM per_turn GROUP BY session_id
  HAVING min(turn) = 1 AND NOT bool_or(broken) AND NOT bool_or(empty) AND bool_and(answered)
)
SELECT session_id FROM sessions WHERE session_id NOT IN (SELECT session_id FROM kept WHERE session_id IS NOT NULL)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p3_found": P3_FOUND}
