"""Transcripts in JSONL files, one file for each conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "type string, message struct<model:string,stop_reason:string,usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>>"
COUNTS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_input_tokens": "cache_read_tokens", "cache_creation_input_tokens": "cache_creation_tokens"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """id (the file), at (a line's place), value. Long files are read in parts: place is the part's offset, then the order in it."""
    rows = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"))
    return rows.select(F.col("_metadata.file_path").alias("id"), at.alias("at"), "value")


def last_usage(lines: DataFrame) -> DataFrame:
    """lines (id, at, value) to a row for each transcript with usage: the sums of its last turn, and the last model and
    stop reason named in it.

    The turn reaches from the end back to the first user line that stands before some usage. Lines that are not JSON or
    of other types are passed over. Native: no file is held as a whole."""
    rows = lines.select("id", "at", F.from_json("value", LINE).alias("x")).select("id", "at", "x.type", "x.message")
    rows = rows.filter(F.col("type").isin("user", "assistant"))
    used = (F.col("type") == "assistant") & F.col("message.usage").isNotNull()
    last = rows.groupBy("id").agg(F.max(F.when(used, F.col("at"))).alias("last")).filter("last is not null")
    rows = rows.join(last, "id")
    stop = F.max(F.when((F.col("type") == "user") & (F.col("at") < F.col("last")), F.col("at")))
    rows = rows.join(rows.groupBy("id").agg(stop.alias("stop")), "id")
    turn = rows.filter((F.col("type") == "assistant") & F.col("message").isNotNull() & (F.col("stop").isNull() | (F.col("at") > F.col("stop"))))
    sums = [F.sum(F.coalesce(f"message.usage.{a}", F.lit(0))).alias(b) for a, b in COUNTS.items()]
    named = [F.max_by(f"message.{c}", F.when(F.col(f"message.{c}").isNotNull(), F.col("at"))).alias(c) for c in ("model", "stop_reason")]
    return turn.groupBy("id").agg(*sums, *named)
