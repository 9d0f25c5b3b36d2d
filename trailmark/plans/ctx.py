"""Cache, transcript and storage queries, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import ctx
from trailmark.sources.adapters import REQUESTS, requests, table


def reads(spark, sf_dir):
    r = requests(spark, sf_dir).filter("tool_name = 'Read'")
    return r.select("session_id", F.col("file_path").alias("path"), F.col("timestamp").alias("read_at"), "id", (F.col("k") % 2).alias("hash"), F.col("input_tokens").alias("tokens"))


_READS = REQUESTS + """, reads AS (SELECT session_id, file_path AS path, "timestamp" AS read_at, id, k % 2 AS hash, input_tokens AS tokens FROM requests WHERE tool_name = 'Read'),
hits AS (SELECT session_id, path, read_at, id, hash, tokens, hit, 'F' || dense_rank() OVER (PARTITION BY session_id ORDER BY first) AS ref, CASE WHEN hit THEN 0 ELSE tokens END AS sent FROM (
  SELECT *, coalesce(lag(hash) OVER (PARTITION BY session_id, path ORDER BY read_at, id) = hash, false) AS hit, min(id) OVER (PARTITION BY session_id, path) AS x, min(read_at) OVER (PARTITION BY session_id, path) AS first FROM reads))"""


def entries(spark, sf_dir):
    return reads(spark, sf_dir).groupBy("session_id", "path").agg(F.count(F.lit(1)).alias("reads"), F.max("tokens").alias("tokens"), (F.max("id") % 977).alias("age_s"))


def transcripts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("id"), F.col("turn").alias("line"), "role", F.when(F.col("role") == "assistant", F.length("text")).alias("tokens"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("m"), (F.col("turn") % 4).cast("string"))).alias("model"))


def entry_hits(spark, sf_dir):
    """Entries from a third of the texts and one that nothing meets."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = d.filter("doc_id % 3 = 0").select(ctx.content_hash(F.col("text")).alias("hash"), F.lit("x").alias("compressed")).unionByName(spark.sql("select 'none' as hash, 'x' as compressed")).dropDuplicates(["hash"])
    return ctx.hit_counts(ctx.with_cache(d, "text", cache), cache)


PLANS = {
    "ctx1_win5_cache_hits": (lambda s, d: ctx.cache_hits(reads(s, d)), f"WITH {_READS} SELECT * FROM hits"),
    "ctx1_cache_totals": (
        lambda s, d: ctx.cache_totals(reads(s, d)),
        f"WITH {_READS} SELECT session_id, count(*) AS reads, count(*) FILTER (hit) AS hits, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(sent) AS BIGINT) AS sent FROM hits GROUP BY 1",
    ),
    "ctx2_evicted": (
        lambda s, d: ctx.evicted(entries(s, d), 1000).select("session_id", "path", "tokens"),
        f"""WITH {_READS}, e AS (SELECT session_id, path, count(*) AS reads, max(tokens) AS tokens, max(id) % 977 AS age_s FROM reads GROUP BY 1, 2),
        s AS (SELECT *, round(0.4 / (1 + sqrt(age_s)) + 0.3 * ln(reads + 1) + 0.3 * ln(tokens + 1), 9) AS score FROM e),
        w AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) - 1000 AS over_by, coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY score, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
        SELECT session_id, path, tokens FROM w WHERE before < over_by""",
    ),
    "ctx6_read_modes": (
        lambda s, d: ctx.cache_hits(reads(s, d)).select("id", ctx.read_mode(F.col("hash") == 1, F.col("hit"), F.col("tokens"), F.col("tokens") * (F.col("id") % 2)).alias("mode")),
        f"WITH {_READS} SELECT id, CASE WHEN hash = 1 AND hit THEN 'stub' WHEN hash = 1 AND tokens * (id % 2) < tokens * 0.6 THEN 'diff' ELSE 'full' END AS mode FROM hits",
    ),
    "agg34_transcript_usage": (
        lambda s, d: ctx.transcript_usage(transcripts(s, d)),
        """WITH t AS (SELECT conv_id AS id, turn AS line, role, CASE WHEN role = 'assistant' THEN length(text) END AS tokens, CASE WHEN turn % 2 = 1 THEN 'm' || (turn % 4) END AS model FROM conversations),
        l AS (SELECT id, max(line) FILTER (role = 'assistant' AND tokens IS NOT NULL) AS last FROM t GROUP BY id),
        p AS (SELECT t.id, max(line) AS stop FROM t JOIN l USING (id) WHERE role = 'user' AND line < last GROUP BY t.id)
        SELECT t.id, sum(tokens) AS tokens, max_by(model, line) FILTER (model IS NOT NULL) AS model, count(*) AS calls FROM t JOIN l USING (id) LEFT JOIN p USING (id) WHERE role = 'assistant' AND tokens IS NOT NULL AND line <= last AND line > coalesce(stop, -1) GROUP BY t.id""",
    ),
    "snk4_latest": (
        lambda s, d: ctx.latest(requests(s, d).select("session_id", "endpoint_name", F.col("id").alias("updated_at"), "model"), "session_id", "endpoint_name"),
        f"WITH {REQUESTS} SELECT session_id, endpoint_name, id AS updated_at, model FROM requests QUALIFY row_number() OVER (PARTITION BY session_id, endpoint_name ORDER BY id DESC) = 1",
    ),
    "snk7_jon10_cache_lookup": (
        lambda s, d: ctx.with_cache(table(s, d, "documents").select("doc_id", "text"), "text", table(s, d, "documents").filter("doc_id % 3 = 0").select(ctx.content_hash(F.col("text")).alias("hash"), F.lit("x").alias("compressed")).dropDuplicates(["hash"])).select("doc_id", "hash", "hit"),
        "SELECT doc_id, left(md5(text), 16) AS hash, left(md5(text), 16) IN (SELECT left(md5(text), 16) FROM documents WHERE doc_id % 3 = 0) AS hit FROM documents",
    ),
    "snk7_entry_hits": (
        entry_hits,
        "SELECT left(md5(text), 16) AS hash, count(*) AS hits FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) GROUP BY 1 UNION ALL SELECT 'none', 0",
    ),
    "snk8_codec_round_trip": (
        lambda s, d: table(s, d, "documents").select("doc_id", ctx.decoded(ctx.encoded(F.col("text"))).alias("text")),
        "SELECT doc_id, text FROM documents",
    ),
    "ctx4_differences": (
        lambda s, d: table(s, d, "documents").select("doc_id", ctx.differences(F.concat(F.lit("first\n"), F.col("text")), F.concat(F.lit("first\nsecond\n"), F.col("text"))).alias("diff")),
        "SELECT doc_id, '+2: second' || chr(10) || '∂ +1/-0 lines' AS diff FROM documents",
    ),
}
