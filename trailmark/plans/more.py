"""Smaller operators of the inventory, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import ctx, deps, dlp, filters, stats
from trailmark.plans.dlp import _CUSTOM, custom_scan
from trailmark.sources.adapters import REQUESTS, requests, table

#: Numbers with known verdicts.
VECTORS = [
    ("verhoeff", "276598387210", True), ("verhoeff", "498123456788", True), ("verhoeff", "123456789012", False), ("verhoeff", "585293751385", False),
    ("iban", "GB82 WEST 1234 5698 7654 32", True), ("iban", "GB82 WEST 1234 5698 7654 31", False), ("iban", "DE75512108001245126199", True),
    ("uk_nino", "AB 12 34 56 C", True), ("uk_nino", "BG 12 34 56 A", False), ("uk_nino", "AB 00 00 00 A", False),
    ("luhn", "4532015112830366", True), ("luhn", "4532015112830367", False), ("luhn", "4532-0151-1283-0366", True),
]


def validators(spark, sf_dir):
    v = spark.createDataFrame([x[:2] for x in VECTORS], "validator string, value string")
    ok = None
    for name, check in dlp.VALIDATORS.items():
        one = F.col("validator") == name
        ok = F.when(one, check(F.col("value"))) if ok is None else ok.when(one, check(F.col("value")))
    return v.select("validator", "value", F.coalesce(ok, F.lit(False)).alias("ok"))


def full_models(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.when(k % 3 == 0, F.concat(F.lit("claude-opus-4-"), (k % 2).cast("string"), F.lit("-20250514"))).otherwise(F.concat(F.lit("model-"), (k % 4).cast("string"))).alias("model"))


_MODELS = "(SELECT event_id, CASE WHEN k % 3 = 0 THEN 'opus-4-' || (k % 2) ELSE 'model-' || (k % 4) END AS model FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"


def guardian_reasons(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    response = F.when(k % 5 == 0, F.lit('{"decision":"deny"}')).when(k % 5 == 1, F.lit('{"reason":"why","decision":"ask"}')).when(k % 5 == 2, F.lit("not json"))
    response = response.when(k % 5 == 3, F.lit('{"reason":"later","hookSpecificOutput":{"permissionDecisionReason":"hook"}}')).otherwise(F.lit('{"hook_specific_output":{"permission_decision_reason":"snake"}}'))
    request = F.when(k % 3 == 0, F.lit('{"toolName":"T"}')).when(k % 3 == 1, F.lit('{"toolName":"T","tool_name":"U"}')).otherwise(F.lit("plain"))
    meta = F.when(k % 4 == 0, F.lit('{"tool_name":"M"}'))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.lit("b").alias("backend"), F.lit(None).cast("string").alias("model"), meta.alias("extra_metadata"), request.alias("request_body"), response.alias("response_body"), F.lit(1).alias("tokens_saved"), F.lit(0).alias("input_tokens"))
    return stats.summaries(rows).select("id", "model", "tool_name", "guardian_reason", "reduction_pct")


def detections_by_backend(spark, sf_dir):
    found = custom_scan(spark, sf_dir)
    r = requests(spark, sf_dir).select("id", "backend")
    return found.join(r, found.doc_id == r.id).groupBy("backend", "name").agg(F.sum("n").alias("n"))


def exports(spark, sf_dir):
    r = requests(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.col("request_body")).otherwise(F.lit("plain text")).alias("request_body"))
    return ctx.exported(r)


def manifests(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a/b/"), F.element_at(F.array(*[F.lit(x) for x in ("requirements-dev.txt", "PACKAGE.json", "go.mod", "x.csproj", "readme.md", "gemfile.lock")]), F.col("p_partkey").cast("int") % 6 + 1)).alias("path"))
    return p.select("p_partkey", "path", deps.is_manifest(F.col("path")).alias("manifest"))


PLANS = {
    "dlp6_7_8_9_validators": (validators, "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in VECTORS) + ") AS t(validator, value, ok)"),
    "prj7_agg25_short_models": (
        lambda s, d: full_models(s, d).groupBy(stats.short_model(F.col("model")).alias("model")).agg(F.count(F.lit(1)).alias("n")),
        f"SELECT model, count(*) AS n FROM {_MODELS} GROUP BY 1",
    ),
    "prj2_guardian_reasons": (
        guardian_reasons,
        "SELECT event_id AS id, 'unknown' AS model, CASE WHEN k % 4 = 0 THEN 'M' WHEN k % 3 = 0 THEN 'T' WHEN k % 3 = 1 THEN 'U' END AS tool_name, CASE k % 5 WHEN 0 THEN 'Decision: deny' WHEN 1 THEN 'why' WHEN 3 THEN 'hook' WHEN 4 THEN 'snake' END AS guardian_reason, 0.0 AS reduction_pct FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
    ),
    "jon2_detections_by_backend": (
        detections_by_backend,
        f"WITH {REQUESTS} SELECT backend, name, count(*) AS n FROM {_CUSTOM} d JOIN requests r ON r.id = d.doc_id GROUP BY 1, 2",
    ),
    "agg28_project_ratio": (
        lambda s, d: stats.projects(requests(s, d)).select("cwd", F.round(F.try_divide(F.col("cache_read") * 100.0, F.col("input_tokens")), 4).alias("cache_pct")),
        f"WITH {REQUESTS} SELECT cwd, round(sum(cache_read_tokens) * 100.0 / sum(input_tokens + cache_read_tokens + cache_creation_tokens), 4) AS cache_pct FROM requests GROUP BY 1",
    ),
    "agg33_cache_stats": (
        lambda s, d: requests(s, d).filter("tokens_saved > 0").groupBy(ctx.content_hash(F.col("response_body")).alias("hash")).agg(F.sum("tokens_saved").alias("saved"), F.count(F.lit(1)).alias("hits")).agg(F.count(F.lit(1)).alias("entries"), F.sum("saved").alias("saved"), F.sum("hits").alias("hits")),
        f"WITH {REQUESTS} SELECT count(DISTINCT left(md5(response_body), 16)) AS entries, CAST(sum(tokens_saved) AS BIGINT) AS saved, count(*) AS hits FROM requests WHERE tokens_saved > 0",
    ),
    "dep8_manifests": (
        manifests,
        "SELECT p_partkey, path, regexp_matches(path, '(requirements-dev.txt|PACKAGE.json|go.mod|x.csproj)$') AS manifest FROM (SELECT p_partkey, 'a/b/' || ['requirements-dev.txt', 'PACKAGE.json', 'go.mod', 'x.csproj', 'readme.md', 'gemfile.lock'][p_partkey % 6 + 1] AS path FROM part)",
    ),
    "snk5_seeded_patterns": (
        lambda s, d: ctx.seeded(table(s, d, "part").select(F.col("p_name").alias("name"), "p_partkey"), table(s, d, "part").filter("p_partkey % 5 = 0").select(F.col("p_name").alias("name"), F.lit(False).alias("enabled")).dropDuplicates(["name"])),
        "SELECT p_name AS name, p_partkey, p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 5 = 0) AS enabled FROM part",
    ),
    "snk6_export": (exports, f"WITH {REQUESTS} SELECT id, CASE WHEN id % 2 = 0 THEN replace(request_body, ' ', '') ELSE '\"plain text\"' END AS request_body FROM requests"),
    "wins_2_3_first_last": (
        lambda s, d: requests(s, d).filter(filters.prompts()).groupBy("session_id").agg(F.min_by("backend", F.struct("timestamp", "id")).alias("backend"), F.min_by("id", F.struct("timestamp", "id")).alias("first_id"), F.max_by("id", F.struct("timestamp", "id")).alias("last_id")),
        f'WITH {REQUESTS} SELECT session_id, arg_min(backend, "timestamp") AS backend, arg_min(id, "timestamp") AS first_id, arg_max(id, "timestamp") AS last_id FROM requests WHERE endpoint_name = \'AgentPrompt\' GROUP BY 1',
    ),
}
