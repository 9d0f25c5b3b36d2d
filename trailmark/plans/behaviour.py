"""Session behaviour over the adapter views, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import behaviour as b
from trailmark.sources.adapters import REQUESTS, requests

VIEWS = (
    REQUESTS
    + """, ordered AS (
  SELECT *, CASE WHEN endpoint_name = 'AgentPrompt' THEN 0 ELSE 1 END AS kind FROM requests
), marked AS (
  SELECT *, last_value(CASE WHEN kind = 0 THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY "timestamp", kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt_id FROM ordered
), turns AS (
  SELECT *, is_write * coalesce(max(is_read) OVER (PARTITION BY session_id, file_path ORDER BY "timestamp", kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS read_before
  FROM (SELECT *, CASE WHEN tool_name = 'Read' THEN 1 ELSE 0 END AS is_read, CASE WHEN tool_name = 'Edit' THEN 1 ELSE 0 END AS is_write FROM marked WHERE kind = 1 AND prompt_id IS NOT NULL)
), by_tools AS (
  SELECT session_id, count(*) AS tools, count(*) FILTER (tool_name = 'Read') AS explore, count(*) FILTER (tool_name IN ('Edit', 'Bash')) AS modify, count(*) FILTER (tool_name = 'Bash') AS bash,
    CAST(sum(is_read) AS BIGINT) AS files_read, count(DISTINCT CASE WHEN is_read = 1 THEN file_path END) AS unique_files_read, CAST(sum(is_write) AS BIGINT) AS files_written,
    count(DISTINCT CASE WHEN is_write = 1 THEN file_path END) AS unique_files_written, CAST(sum(read_before) AS BIGINT) AS read_first FROM turns GROUP BY 1
), by_prompts AS (
  SELECT session_id, min(backend) AS backend, min(cwd) AS cwd, min("timestamp") AS first_seen, max("timestamp") AS last_seen, count(*) AS turns,
    CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, count(*) FILTER (dlp_action >= 2) AS blocked
  FROM requests WHERE endpoint_name = 'AgentPrompt' GROUP BY 1
), filled AS (
  SELECT p.*, coalesce(tools, 0) AS tools, coalesce(explore, 0) AS explore, coalesce(modify, 0) AS modify, coalesce(bash, 0) AS bash, coalesce(files_read, 0) AS files_read, coalesce(unique_files_read, 0) AS unique_files_read,
    coalesce(files_written, 0) AS files_written, coalesce(unique_files_written, 0) AS unique_files_written, coalesce(read_first, 0) AS read_first FROM by_prompts p LEFT JOIN by_tools USING (session_id)
), sessions AS (
  SELECT *, split_part(cwd, '/', -1) AS display_name, greatest((epoch_us(last_seen) - epoch_us(first_seen)) // 1000, 0) AS duration_ms,
    round(CASE WHEN files_written = 0 THEN 100.0 ELSE read_first * 100.0 / files_written END, 4) AS read_first_pct,
    round(CASE WHEN modify = 0 THEN CAST(explore AS DOUBLE) ELSE CAST(explore AS DOUBLE) / modify END, 4) AS exploration FROM filled
)"""
)
_WEIGHTED = """count(*) AS sessions, round(CASE WHEN sum(files_written) > 0 THEN sum(read_first) * 100.0 / sum(files_written) END, 3) AS read_first_pct,
  round(CASE WHEN sum(modify) > 0 THEN CAST(sum(explore) AS DOUBLE) / sum(modify) WHEN sum(explore) > 0 THEN CAST(sum(explore) AS DOUBLE) END, 3) AS exploration,
  round(CASE WHEN sum(tools) > 0 THEN sum(bash) * 100.0 / sum(tools) END, 3) AS bash_pct, round(CASE WHEN sum(turns) > 0 THEN CAST(sum(tools) AS DOUBLE) / sum(turns) END, 3) AS tempo,
  count(DISTINCT cwd) AS projects, count(*) FILTER (blocked > 0) AS blocked_sessions, CAST(sum(blocked) AS BIGINT) AS blocked_turns FROM sessions"""
_BAND = "CASE WHEN {0} IS NULL THEN 'none' WHEN {0} >= {2} THEN 'high' WHEN {0} >= {1} THEN 'mid' ELSE 'low' END"
_BASH, _TEMPO = "(CASE WHEN tools > 0 THEN bash * 100.0 / tools END)", "(CASE WHEN turns > 0 THEN CAST(tools AS DOUBLE) / turns END)"

PLANS = {
    "jon3_9_turns": (
        lambda s, d: b.turns(requests(s, d)).select("id", "session_id", "prompt_id", "tool_name", "is_read", "is_write", "read_before"),
        f"WITH {VIEWS} SELECT id, session_id, prompt_id, tool_name, is_read, is_write, read_before FROM turns",
    ),
    "agg19_session_behaviour": (lambda s, d: b.sessions(requests(s, d)), f"WITH {VIEWS} SELECT * FROM sessions"),
    "agg20_overall_behaviour": (
        lambda s, d: b.overall(b.sessions(requests(s, d))),
        f"WITH {VIEWS} SELECT count(*) AS sessions, round(avg(turns), 3) AS turns, round(avg(read_first_pct), 3) AS read_first_pct, round(avg(exploration), 3) AS exploration FROM sessions",
    ),
    "agg21_weighted_behaviour": (lambda s, d: b.weighted(b.sessions(requests(s, d))), f"WITH {VIEWS} SELECT {_WEIGHTED}"),
    "agg22_behaviour_by_day": (
        lambda s, d: b.weighted(b.sessions(requests(s, d)), F.to_date("first_seen").cast("string").alias("day")),
        f'WITH {VIEWS} SELECT CAST(CAST(first_seen AS DATE) AS VARCHAR) AS day, {_WEIGHTED} GROUP BY 1',
    ),
    "agg23_tool_mix": (
        lambda s, d: b.tool_mix(b.sessions(requests(s, d))),
        f"WITH {VIEWS}, t AS (SELECT sum(explore) AS explore, sum(modify) - sum(bash) AS modify, sum(bash) AS bash, sum(tools) - sum(explore) - sum(modify) AS other, sum(tools) AS total FROM sessions) SELECT kind, CAST(n AS BIGINT) AS n, round(n * 100.0 / total, 3) AS pct FROM (SELECT 'explore' AS kind, explore AS n, total FROM t UNION ALL SELECT 'modify', modify, total FROM t UNION ALL SELECT 'bash', bash, total FROM t UNION ALL SELECT 'other', other, total FROM t)",
    ),
    "agg24_session_flags": (
        lambda s, d: b.flags(b.sessions(requests(s, d))),
        f"""WITH {VIEWS} SELECT session_id, array_to_string(list_filter([CASE WHEN blocked > 0 THEN 'blocked' END,
          CASE WHEN files_written > 0 AND read_first_pct >= 85 THEN 'read-first' WHEN files_written > 0 AND read_first_pct < 60 THEN 'edit-first' END,
          CASE WHEN {_BASH} >= 30 THEN 'bash-heavy' END, CASE WHEN exploration >= 2.5 THEN 'deep-scan' WHEN files_written > 0 AND exploration < 0.8 THEN 'low-explore' END,
          CASE WHEN {_TEMPO} >= 4.5 THEN 'high-tempo' END], lambda x: x IS NOT NULL)[1:4], ',') AS flags,
          {_BAND.format('(CASE WHEN files_written > 0 THEN read_first_pct END)', 70, 85)} AS read_band, {_BAND.format('exploration', 1, 2.5)} AS explore_band,
          {_BAND.format(_BASH, 15, 30)} AS bash_band, {_BAND.format(_TEMPO, 2.5, 4.5)} AS tempo_band FROM sessions""",
    ),
}
