"""Batch runs of the stateful log over events; streams run the same rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.sources.adapters import table
from trailmark.streaming import upsert


def hook_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type").isin("view", "signup"), "request").when(F.col("event_type") == "click", "output").when(F.col("event_type") == "purchase", "close_usage").otherwise("saving")
    # Five users share a session, and seconds stand for days, so that look-backs matter.
    ts = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 20))
    return e.select(
        F.col("event_id").alias("seq"), ts.alias("ts"), F.lit("hooks-a").alias("backend"), F.concat(F.lit("s"), F.floor(F.col("user_id") / 5).cast("string")).alias("session_id"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("correlation_id"), F.lit("AgentPrompt").alias("endpoint_name"), kind.alias("kind"), k.alias("tokens"),
        (k % 3).alias("cache_tokens"), F.lit(200).alias("status"), (k % 3).cast("int").alias("action"), F.when(k % 2 == 0, "m").alias("model"), F.when(k % 2 == 1, "done").alias("response"), F.lit("{}").alias("meta"),
    )


PLANS = {"str1_10_upserts": (lambda s, d: upsert.batch(hook_events(s, d)), None)}
