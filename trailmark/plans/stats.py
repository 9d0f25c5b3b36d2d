"""Dashboard and log queries over the adapter views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import filters as flt
from trailmark.operators import stats
from trailmark.sources.adapters import REQUESTS, TOOL_CALLS, requests, table, tool_calls

_NOW = '(SELECT max("timestamp") FROM requests)'


def _sql(body: str, views: str = REQUESTS) -> str:
    return f"WITH {views} {body}"


PLANS = {
    "flt1_time_range": (
        lambda s, d: (r := requests(s, d)).filter(flt.since(flt.clock(r), "7d")).select("id", "session_id"),
        _sql(f'SELECT id, session_id FROM requests WHERE "timestamp" >= {_NOW} - INTERVAL 168 HOURS'),
    ),
    "flt2_backend": (
        lambda s, d: requests(s, d).filter(flt.of_backend("hooks-b")).select("id", "backend"),
        _sql("SELECT id, backend FROM requests WHERE backend = 'hooks-b'"),
    ),
    "flt3_model": (
        lambda s, d: requests(s, d).filter(flt.of_model("unknown")).select("id"),
        _sql("SELECT id FROM requests WHERE coalesce(model, 'unknown') = 'unknown'"),
    ),
    "flt4_action": (
        lambda s, d: requests(s, d).filter(flt.of_action("blocked")).select("id", "dlp_action"),
        _sql("SELECT id, CAST(dlp_action AS INTEGER) AS dlp_action FROM requests WHERE dlp_action = 2"),
    ),
    "flt5_views": (
        lambda s, d: requests(s, d).filter(flt.of_view("token_saving") & flt.of_view("guardian")).select("id", "tokens_saved"),
        _sql("SELECT id, tokens_saved FROM requests WHERE tokens_saved > 0 AND dlp_action > 0"),
    ),
    "flt6_search": (
        lambda s, d: requests(s, d).filter(flt.mentions("R 7 DID")).select("id", "response_body"),
        _sql("SELECT id, response_body FROM requests WHERE contains(lower(request_body), 'r 7 did') OR contains(lower(response_body), 'r 7 did')"),
    ),
    "flt7_endpoint_class": (
        lambda s, d: requests(s, d).groupBy(flt.prompts().alias("is_prompt"), flt.tools().alias("is_tool")).agg(F.count(F.lit(1)).alias("n")),
        _sql("SELECT endpoint_name ILIKE '%prompt%' AS is_prompt, endpoint_name ILIKE '%tool%' AS is_tool, count(*) AS n FROM requests GROUP BY 1, 2"),
    ),
    "flt8_point_lookup": (
        lambda s, d: requests(s, d).filter("id = 42").select("id", "session_id", "request_body"),
        _sql("SELECT id, session_id, request_body FROM requests WHERE id = 42"),
    ),
    "flt9_positive_latency": (
        lambda s, d: requests(s, d).filter("latency_ms > 0").select("id", "latency_ms"),
        _sql("SELECT id, latency_ms FROM requests WHERE latency_ms > 0"),
    ),
    "flt10_generated_files": (
        lambda s, d: table(s, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, "/dist/a.js").when(F.col("page_id") % 3 == 1, "/Yarn.lock").otherwise("/a.py")).alias("path")).filter(~flt.generated(F.col("path"))),
        "SELECT page_id, path FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN '/dist/a.js' WHEN 1 THEN '/Yarn.lock' ELSE '/a.py' END AS path FROM pages) WHERE NOT regexp_matches(path, '(\\.lock$|lock\\.json$|\\.sum$|\\.min\\.js$|\\.min\\.css$|\\.bundle\\.js$|\\.map$|\\.generated\\.|\\.pb\\.go$|\\.g\\.dart$|/dist/|/build/|/node_modules/|/vendor/)', 'i')",
    ),
    "prj1_log_page": (
        lambda s, d: stats.summaries(stats.page(stats.logs(requests(s, d), "7d", "hooks-a"), 2, 25)),
        _sql(f'SELECT id, "timestamp", backend, coalesce(model, \'unknown\') AS model, tool_name, CAST(NULL AS VARCHAR) AS guardian_reason, round(CASE WHEN input_tokens = 0 THEN 0 ELSE tokens_saved * 100 / input_tokens END, 1) AS reduction_pct FROM requests WHERE "timestamp" >= {_NOW} - INTERVAL 168 HOURS AND backend = \'hooks-a\' ORDER BY id DESC LIMIT 25 OFFSET 50'),
    ),
    "prj4_export": (
        lambda s, d: stats.logs(requests(s, d), "all", "all", "model-1", "passed", "view").select("id", "timestamp", "backend", "model", "input_tokens", "output_tokens", "latency_ms", "request_body", "response_body"),
        _sql("SELECT id, \"timestamp\", backend, model, input_tokens, output_tokens, latency_ms, request_body, response_body FROM requests WHERE model = 'model-1' AND dlp_action = 0 AND (contains(lower(request_body), 'view') OR contains(lower(response_body), 'view'))"),
    ),
    "prj5_latency_points": (
        lambda s, d: requests(s, d).filter("latency_ms > 0").select("id", "timestamp", "latency_ms", "backend"),
        _sql('SELECT id, "timestamp", latency_ms, backend FROM requests WHERE latency_ms > 0'),
    ),
    "agg1_tray": (
        lambda s, d: stats.tray(requests(s, d)),
        _sql(f'SELECT backend, count(*) AS n, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(cache_read_tokens + cache_creation_tokens) AS cache_tokens FROM requests WHERE "timestamp" >= {_NOW} - INTERVAL 24 HOURS GROUP BY backend'),
    ),
    "agg2_models": (
        lambda s, d: stats.models(requests(s, d)),
        _sql("SELECT model, count(*) AS n FROM requests WHERE model IS NOT NULL GROUP BY model"),
    ),
    "agg3_5_13_overview": (
        lambda s, d: stats.overview(requests(s, d)),
        _sql("SELECT count(*) AS n, sum(has_system_prompt) AS has_system_prompt, sum(has_tools) AS has_tools, sum(has_thinking) AS has_thinking, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(cache_read_tokens) AS cache_read_tokens, sum(cache_creation_tokens) AS cache_creation_tokens, round(coalesce(avg(latency_ms) FILTER (latency_ms > 0), 0), 4) AS avg_latency_ms, round(avg(CASE WHEN cache_read_tokens > 0 THEN 100.0 ELSE 0.0 END), 4) AS cache_hit_pct FROM requests"),
    ),
    "agg6_choices": (
        lambda s, d: stats.choices(requests(s, d), "model"),
        _sql("SELECT DISTINCT coalesce(model, 'unknown') AS model FROM requests"),
    ),
    "agg7_count": (
        lambda s, d: stats.logs(requests(s, d), "1d", view="guardian").agg(F.count(F.lit(1)).alias("n")),
        _sql(f'SELECT count(*) AS n FROM requests WHERE "timestamp" >= {_NOW} - INTERVAL 24 HOURS AND dlp_action > 0'),
    ),
    "agg8_tool_usage": (
        lambda s, d: stats.tool_usage(tool_calls(s, d), requests(s, d)),
        _sql("SELECT t.tool_name, count(*) AS n FROM tool_calls t JOIN requests r ON r.id = t.request_id GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20", TOOL_CALLS),
    ),
    "agg9_10_tool_insights": (
        lambda s, d: stats.tool_insights(tool_calls(s, d)),
        _sql("""SELECT tool_name, target, n, tool_n FROM (
          SELECT tool_name, target, n, CAST(sum(n) OVER (PARTITION BY tool_name) AS BIGINT) AS tool_n, row_number() OVER (PARTITION BY tool_name ORDER BY n DESC, target) AS rk
          FROM (SELECT tool_name, coalesce(file_path, split_part(command, ' ', 1)) AS target, count(*) AS n FROM tool_calls GROUP BY 1, 2)) WHERE rk <= 5
        UNION ALL SELECT tool_name, '(other)', CAST(sum(n) AS BIGINT), any_value(tool_n) FROM (
          SELECT tool_name, target, n, CAST(sum(n) OVER (PARTITION BY tool_name) AS BIGINT) AS tool_n, row_number() OVER (PARTITION BY tool_name ORDER BY n DESC, target) AS rk
          FROM (SELECT tool_name, coalesce(file_path, split_part(command, ' ', 1)) AS target, count(*) AS n FROM tool_calls GROUP BY 1, 2)) WHERE rk > 5 GROUP BY tool_name""", TOOL_CALLS),
    ),
    "agg11_savings": (
        lambda s, d: stats.savings(requests(s, d)),
        _sql("SELECT 'shell_compression' AS method, sum(tokens_saved) AS saved, count(*) AS n FROM requests WHERE tokens_saved > 0"),
    ),
    "agg12_home_facts": (
        lambda s, d: stats.facts(requests(s, d)),
        _sql(f"""SELECT count(*) FILTER ("timestamp" >= {_NOW} - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER ("timestamp" >= {_NOW} - INTERVAL 24 HOUR) AS last_day, count(*) AS total,
          coalesce(sum(tokens_saved) FILTER ("timestamp" >= {_NOW} - INTERVAL 24 HOUR), 0) AS saved_day,
          round(coalesce(avg(latency_ms) FILTER ("timestamp" >= {_NOW} - INTERVAL 24 HOUR AND latency_ms > 0), 0), 4) AS avg_latency_day,
          count(*) FILTER ("timestamp" >= {_NOW} - INTERVAL 168 HOUR AND dlp_action > 0) AS flagged_week, max("timestamp") FILTER (backend = 'hooks-a') AS last_a,
          (SELECT model FROM requests WHERE model IS NOT NULL AND "timestamp" >= {_NOW} - INTERVAL 168 HOUR GROUP BY model ORDER BY count(*) DESC, model LIMIT 1) AS top_model,
          (SELECT tool_name FROM requests WHERE tool_name IS NOT NULL AND "timestamp" >= {_NOW} - INTERVAL 168 HOUR GROUP BY tool_name ORDER BY count(*) DESC, tool_name LIMIT 1) AS top_tool_name FROM requests"""),
    ),
    "agg14_projects": (
        lambda s, d: stats.projects(requests(s, d)),
        _sql("SELECT cwd, sum(input_tokens + cache_read_tokens + cache_creation_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(cache_read_tokens) AS cache_read, count(*) AS n, max(\"timestamp\") AS last_used, string_agg(DISTINCT backend, ',' ORDER BY backend) AS backends FROM requests GROUP BY cwd"),
    ),
    "agg15_project_totals": (
        lambda s, d: stats.projects(requests(s, d).filter("cwd = '/p/proj3'")),
        _sql("SELECT cwd, sum(input_tokens + cache_read_tokens + cache_creation_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(cache_read_tokens) AS cache_read, count(*) AS n, max(\"timestamp\") AS last_used, string_agg(DISTINCT backend, ',' ORDER BY backend) AS backends FROM requests WHERE cwd = '/p/proj3' GROUP BY cwd"),
    ),
    "agg16_file_touches": (
        lambda s, d: stats.touches(requests(s, d), tool_calls(s, d)),
        _sql("""SELECT path, count(*) AS n, string_agg(DISTINCT backend, ',' ORDER BY backend) AS backends, max("timestamp") AS last_used FROM (
          SELECT backend, "timestamp", file_path AS path FROM requests WHERE file_path IS NOT NULL
          UNION ALL SELECT r.backend, r."timestamp", '/p/src/' || t.file_path FROM tool_calls t JOIN requests r ON r.id = t.request_id WHERE t.file_path IS NOT NULL
          UNION ALL SELECT r.backend, r."timestamp", 'src/f' || (k % 12) || '.py' FROM tool_calls t JOIN requests r ON r.id = t.request_id WHERE t.command IS NOT NULL) GROUP BY path""", TOOL_CALLS),
    ),
    "agg17_file_rank": (
        lambda s, d: stats.ranked_files(stats.touches(requests(s, d), tool_calls(s, d)), s.range(12).select(F.concat(F.lit("/p/src/f"), F.col("id").cast("string")).alias("path"), (F.col("id") * 100).alias("tokens")), 20),
        _sql("""SELECT path, CASE WHEN path LIKE '/p/src/f%' THEN CAST(substr(path, 9) AS BIGINT) * 100 ELSE 0 END AS tokens, n, CASE WHEN path LIKE '/p/src/f%' THEN CAST(substr(path, 9) AS BIGINT) * 100 ELSE 0 END * n AS weight FROM (SELECT path, count(*) AS n FROM (
          SELECT file_path AS path FROM requests WHERE file_path IS NOT NULL
          UNION ALL SELECT '/p/src/' || file_path FROM tool_calls WHERE file_path IS NOT NULL
          UNION ALL SELECT 'src/f' || (k % 12) || '.py' FROM tool_calls t JOIN requests r ON r.id = t.request_id WHERE t.command IS NOT NULL) GROUP BY path) ORDER BY weight DESC, tokens DESC, n DESC, path LIMIT 20""", TOOL_CALLS),
    ),
    "agg26_modules": (
        lambda s, d: stats.modules(stats.touches(requests(s, d), tool_calls(s, d)).withColumn("tokens", F.lit(10))),
        _sql("""SELECT module, CAST(sum(w) AS BIGINT) AS weight, round(sum(w) * 100.0 / sum(sum(w)) OVER (), 4) AS share FROM (SELECT CASE WHEN path LIKE '/p/%' THEN 'p' WHEN path LIKE 'src/%' THEN 'src' ELSE '(root)' END AS module, 10 * count(*) AS w FROM (
          SELECT file_path AS path FROM requests WHERE file_path IS NOT NULL
          UNION ALL SELECT '/p/src/' || file_path FROM tool_calls WHERE file_path IS NOT NULL
          UNION ALL SELECT 'src/f' || (k % 12) || '.py' FROM tool_calls t JOIN requests r ON r.id = t.request_id WHERE t.command IS NOT NULL) GROUP BY path) GROUP BY module ORDER BY weight DESC, module LIMIT 3""", TOOL_CALLS),
    ),
    "agg29_coins": (
        lambda s, d: stats.coins(stats.projects(requests(s, d))),
        _sql("SELECT cwd, CAST(CASE WHEN g <= 0 THEN 0 ELSE least(greatest(round(g / 100000), 1), 20) END AS BIGINT) AS gold, CAST(CASE WHEN c <= 0 THEN 0 ELSE least(greatest(round(c / 1000000), 1), 20) END AS BIGINT) AS copper FROM (SELECT cwd, CAST(sum(input_tokens + cache_creation_tokens) AS DOUBLE) AS g, CAST(sum(cache_read_tokens) AS DOUBLE) AS c FROM requests GROUP BY cwd)"),
    ),
}
