"""The agent-activity tables as views of the event tables at hand, and the same views in SQL.

`requests` has a row for each prompt or tool event, `tool_calls` one for each tool event with its input as JSON. The clock
(`now`) is the newest timestamp, never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    prompt = F.col("event_type").isin("view", "signup")
    bash = F.col("event_type") == "error"
    file_path = F.when(F.col("event_type").isin("click", "purchase"), F.concat(F.lit("f"), (k % 12).cast("string")))
    session = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    tool = _pick(F.col("event_type"), {"click": "Read", "purchase": "Edit", "error": "Bash"})
    cwd = F.concat(F.lit("/p/proj"), (F.col("user_id") % 7).cast("string"))
    meta = F.to_json(F.struct(session.alias("session_id"), tool.alias("tool_name"), file_path.alias("file_path"), cwd.alias("cwd")))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        session.alias("session_id"),
        _pick(F.col("user_id") % 3, {0: "hooks-a", 1: "hooks-b", 2: "hooks-c"}).alias("backend"),
        F.when(prompt, F.lit("AgentPrompt")).otherwise(F.lit("AgentTool")).alias("endpoint_name"),
        tool.alias("tool_name"),
        file_path.alias("file_path"),
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("model-"), (F.col("user_id") % 4).cast("string"))).alias("model"),
        F.floor("value").alias("input_tokens"),
        F.floor(F.col("value") / 4).alias("output_tokens"),
        F.when(F.col("event_id") % 3 == 0, k).otherwise(0).alias("cache_read_tokens"),
        F.when(F.col("event_id") % 5 == 0, k).otherwise(0).alias("cache_creation_tokens"),
        (k * 10).alias("latency_ms"),
        F.when(bash, F.col("event_id") % 4).otherwise(0).cast("int").alias("dlp_action"),
        F.when(bash, k).otherwise(0).alias("tokens_saved"),
        F.when(bash, F.concat(F.lit('{"shell_compression":'), k.cast("string"), F.lit("}"))).alias("token_saving_meta"),
        cwd.alias("cwd"),
        (F.col("event_id") % 2).cast("int").alias("has_system_prompt"),
        (F.col("event_id") % 3 == 0).cast("int").alias("has_tools"),
        (F.col("event_id") % 7 == 0).cast("int").alias("has_thinking"),
        F.col("props").alias("request_body"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type")).alias("response_body"),
        meta.alias("extra_metadata"),
        k.alias("k"),
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).filter("tool_name is not null")
    command = F.concat(F.lit("sudo make t"), (F.col("k") % 5).cast("string"), F.lit(" && cat src/f"), (F.col("k") % 12).cast("string"), F.lit(".py | wc -l"))
    text = F.when(F.col("tool_name") == "Bash", F.to_json(F.struct(command.alias("command")))).otherwise(F.to_json(F.struct(F.concat(F.lit("/p/src/"), F.col("file_path")).alias("file_path"))))
    return r.select(F.col("id").alias("request_id"), "tool_name", text.alias("tool_input"))


REQUESTS = """requests AS (
  SELECT event_id AS id, ts AS "timestamp", 's' || user_id AS session_id,
    CASE user_id % 3 WHEN 0 THEN 'hooks-a' WHEN 1 THEN 'hooks-b' ELSE 'hooks-c' END AS backend,
    CASE WHEN event_type IN ('view', 'signup') THEN 'AgentPrompt' ELSE 'AgentTool' END AS endpoint_name,
    CASE event_type WHEN 'click' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'error' THEN 'Bash' END AS tool_name,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'f' || (k % 12) END AS file_path,
    CASE WHEN event_id % 10 <> 0 THEN 'model-' || (user_id % 4) END AS model,
    CAST(floor(value) AS BIGINT) AS input_tokens, CAST(floor(value / 4) AS BIGINT) AS output_tokens,
    CASE WHEN event_id % 3 = 0 THEN k ELSE 0 END AS cache_read_tokens,
    CASE WHEN event_id % 5 = 0 THEN k ELSE 0 END AS cache_creation_tokens,
    k * 10 AS latency_ms, CASE WHEN event_type = 'error' THEN event_id % 4 ELSE 0 END AS dlp_action,
    CASE WHEN event_type = 'error' THEN k ELSE 0 END AS tokens_saved,
    CASE WHEN event_type = 'error' THEN '{"shell_compression":' || k || '}' END AS token_saving_meta,
    '/p/proj' || (user_id % 7) AS cwd, event_id % 2 AS has_system_prompt,
    CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS has_tools, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS has_thinking,
    props AS request_body, 'user ' || user_id || ' did ' || event_type AS response_body, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""

TOOL_CALLS = (
    REQUESTS
    + """, tool_calls AS (
  SELECT id AS request_id, tool_name, file_path,
    CASE WHEN tool_name = 'Bash' THEN 'sudo make t' || (k % 5) || ' && cat src/f' || (k % 12) || '.py | wc -l' END AS command
  FROM requests WHERE tool_name IS NOT NULL
)"""
)
