"""Sensitive-data queries over documents, conversations and orders, with SQL where DuckDB's expressions reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import dlp
from trailmark.operators.dlp_catalog import Group
from trailmark.sources.adapters import table

#: A group of user patterns, as one would add to the catalogue.
CUSTOM = (
    Group("Phone", (r"\+1 \([0-9]{3}\) 555-[0-9]{4}",)),
    Group("Mail", (r"[a-z]+\.[0-9]+@mail[0-9]\.example\.com",)),
    Group("Token", (r'token = "[0-9a-f]{40}"',), min_unique_chars=10),
)


def custom_scan(spark, sf_dir):
    found = dlp.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", CUSTOM, "[0-9]")
    return found.select("doc_id", F.explode("detections").alias("d")).select("doc_id", F.col("d.name").alias("name"), F.col("d.value").alias("value")).groupBy("doc_id", "name", "value").agg(F.count(F.lit(1)).alias("n"))


def custom_stats(spark, sf_dir):
    return custom_scan(spark, sf_dir).groupBy("name").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("docs"))


_CUSTOM = """(SELECT doc_id, 'Phone' AS name, unnest(regexp_extract_all(text, '\\+1 \\([0-9]{3}\\) 555-[0-9]{4}')) AS value FROM documents
  UNION ALL SELECT doc_id, 'Mail', unnest(regexp_extract_all(text, '[a-z]+\\.[0-9]+@mail[0-9]\\.example\\.com')) FROM documents
  UNION ALL SELECT doc_id, 'Token', unnest(regexp_extract_all(text, 'token = "[0-9a-f]{40}"')) FROM documents)"""


def card_numbers(spark, sf_dir):
    """Numbers made of order keys, judged by each checksum."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    number = F.lpad((F.col("o_orderkey") * 7919 + 400000).cast("string"), 16, "4539")
    return o.select("o_orderkey", number.alias("number"), dlp.luhn(number).alias("ok"), dlp.unique_chars(number).alias("kinds"))


def decisions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    made = dlp.decision(F.col("text"), F.col("text").contains("@mail"), 200)
    return c.select("conv_id", "turn", dlp.estimated_tokens(F.col("text")).alias("tokens"), made.alias("d")).select("conv_id", "turn", "tokens", "d.status", "d.action")


def builtin_scan(spark, sf_dir):
    found = dlp.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    d = F.explode("detections").alias("d")
    return found.select("doc_id", d).select("doc_id", "d.*", dlp.category(F.col("d.name")).alias("category"))


PLANS = {
    "dlp2_custom_scan": (custom_scan, f"SELECT doc_id, name, value, count(*) AS n FROM {_CUSTOM} GROUP BY 1, 2, 3"),
    "agg18_detection_stats": (custom_stats, f"SELECT name, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {_CUSTOM} GROUP BY 1"),
    "dlp5_6_luhn": (
        card_numbers,
        """SELECT o_orderkey, number, len(list_distinct(d)) > 1 AND list_sum([CASE WHEN i % 2 = 1 THEN d[17 - i] WHEN d[17 - i] > 4 THEN d[17 - i] * 2 - 9 ELSE d[17 - i] * 2 END FOR i IN range(1, 17)]) % 10 = 0 AS ok, CAST(len(list_distinct(d)) AS INTEGER) AS kinds
        FROM (SELECT *, [CAST(substr(number, CAST(i AS INTEGER), 1) AS INTEGER) FOR i IN range(1, 17)] AS d FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 400000 AS VARCHAR), 16, '4539') AS number FROM orders))""",
    ),
    "dlp13_builtin_scan": (builtin_scan, None),
    "dlp15_16_decisions": (
        decisions,
        """SELECT conv_id, turn, tokens, CASE WHEN tokens > 200 THEN 429 WHEN contains(text, '@mail') THEN 403 ELSE 200 END AS status, CASE WHEN tokens > 200 THEN 3 WHEN contains(text, '@mail') THEN 2 ELSE 0 END AS action
        FROM (SELECT *, CAST(floor(len(regexp_extract_all(text, '[^\\s\\x{85}\\x{A0}]+')) * 1.5) AS BIGINT) AS tokens FROM conversations WHERE text IS NOT NULL)""",
    ),
    "dlp17_masking": (
        lambda s, d: table(s, d, "supplier").select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, "API_KEY_").otherwise("PATH_"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_name").alias("value")).select("s_suppkey", "name", dlp.masked(F.col("name"), F.col("value")).alias("shown")),
        "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'API_KEY_' ELSE 'PATH_' END || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN '***' ELSE s_name END AS shown FROM supplier",
    ),
}
