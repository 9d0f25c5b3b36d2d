"""The file-read cache, stored texts and transcripts: hits, references, eviction, differences, codecs, upserts."""

from __future__ import annotations

import base64
import difflib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cache_hits(reads: DataFrame) -> DataFrame:
    """reads (session_id, path, read_at, id, hash, tokens) with ref, hit and sent: a read hits if the session's last read of
    the path saw the same content; paths are F1, F2... by first access; a hit sends nothing, a first read or change all."""
    order = Window.partitionBy("session_id", "path").orderBy("read_at", "id")
    first = F.min(F.struct("read_at", "id")).over(Window.partitionBy("session_id", "path"))
    rows = reads.withColumns({"hit": F.coalesce(F.lag("hash").over(order) == F.col("hash"), F.lit(False)), "first": first})
    ref = F.concat(F.lit("F"), F.dense_rank().over(Window.partitionBy("session_id").orderBy("first")).cast("string"))
    return rows.withColumns({"ref": ref, "sent": F.when(F.col("hit"), F.lit(0)).otherwise(F.col("tokens"))}).drop("first")


def cache_totals(reads: DataFrame) -> DataFrame:
    return cache_hits(reads).groupBy("session_id").agg(F.count(F.lit(1)).alias("reads"), F.count_if("hit").alias("hits"), F.sum("tokens").alias("tokens"), F.sum("sent").alias("sent"))


def eviction_score(age_s: Column, reads: Column, tokens: Column) -> Column:
    return 0.4 / (1 + F.sqrt(age_s)) + 0.3 * F.ln(reads + 1) + 0.3 * F.ln(tokens + 1)


def evicted(entries: DataFrame, budget: int) -> DataFrame:
    """entries (session_id, path, age_s, reads, tokens) that go, lowest score first, until the rest fits the budget."""
    scored = entries.withColumn("score", F.round(eviction_score(F.col("age_s"), F.col("reads"), F.col("tokens")), 9))
    over = F.sum("tokens").over(Window.partitionBy("session_id")) - budget
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("session_id").orderBy("score", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return scored.withColumn("goes", before < over).filter("goes").select("session_id", "path", "score", "tokens")


def difference(old: str, new: str) -> str:
    """Removed lines as -n: and added ones as +n:, then how many of each; '(no changes)' without any."""
    a, b, out, plus, minus = old.splitlines(), new.splitlines(), [], 0, 0
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag != "equal":
            out += [f"-{i + 1}: {a[i]}" for i in range(i1, i2)] + [f"+{j + 1}: {b[j]}" for j in range(j1, j2)]
            minus, plus = minus + i2 - i1, plus + j2 - j1
    return "\n".join([*out, f"∂ +{plus}/-{minus} lines"]) if out else "(no changes)"


def differences(old: Column, new: Column) -> Column:
    def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in series:
            yield pd.Series([difference(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(old, new)


def read_mode(cached: Column, same: Column, full_tokens: Column, diff_tokens: Column) -> Column:
    """stub for an unchanged cached file, diff for a changed one if it is below 60 % of the full text, else full."""
    return F.when(cached & same, F.lit("stub")).when(cached & (diff_tokens < full_tokens * 0.6), F.lit("diff")).otherwise(F.lit("full"))


PREFIX, LEAST = "zstd64:", 512


def encode(text: str | None) -> str | None:
    """Texts of 512 bytes or more as zstd (level 3) in base64, if that is shorter."""
    if text is None or len(text.encode()) < LEAST:
        return text
    packed = PREFIX + base64.b64encode(zstandard.ZstdCompressor(level=3).compress(text.encode())).decode()
    return packed if len(packed) < len(text.encode()) else text


def decode(text: str | None) -> str | None:
    """The text behind a stored one; what cannot be decoded stays as it is."""
    if text is None or not text.startswith(PREFIX):
        return text
    try:
        return zstandard.ZstdDecompressor().decompress(base64.b64decode(text[len(PREFIX) :], validate=True)).decode()
    except (ValueError, zstandard.ZstdError):
        return text


def _column(function):
    def column(text: Column) -> Column:
        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in series:
                yield s.map(lambda x: function(x), na_action="ignore")

        return F.pandas_udf(run, "string")(text)

    return column


encoded, decoded = _column(encode), _column(decode)


def transcript_usage(lines: DataFrame) -> DataFrame:
    """lines (id, line, role, tokens, model) to id, tokens, model, calls: the usage of the last turn.

    From the end back: all assistant lines with usage up to the first user line before the last of them. User lines after the
    last usage do not end the walk."""
    used = (F.col("role") == "assistant") & F.col("tokens").isNotNull()
    last = lines.groupBy("id").agg(F.max(F.when(used, F.col("line"))).alias("last"))
    stop = lines.join(last, "id").filter((F.col("role") == "user") & (F.col("line") < F.col("last"))).groupBy("id").agg(F.max("line").alias("stop"))
    turn = lines.join(last, "id").join(stop, "id", "left").filter(used & (F.col("line") <= F.col("last")) & (F.col("line") > F.coalesce("stop", F.lit(-1))))
    return turn.groupBy("id").agg(F.sum("tokens").alias("tokens"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("line"))).alias("model"), F.count(F.lit(1)).alias("calls"))


def latest(rows: DataFrame, *key: str, at: str = "updated_at") -> DataFrame:
    """One row for each key, the newest: an upsert of everything written so far."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.col(at)).alias("x")).select(*key, "x.*")


def seeded(builtin: DataFrame, stored: DataFrame) -> DataFrame:
    """builtin (name, ...) with the stored enabled flag where there is one."""
    return builtin.join(stored.select("name", "enabled"), "name", "left").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def content_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def with_cache(rows: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """rows with the cached result of equal content, if there is one."""
    return rows.withColumn("hash", content_hash(F.col(text))).join(cache.select("hash", "compressed"), "hash", "left").withColumn("hit", F.col("compressed").isNotNull())


def hit_counts(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """hash, hits: how often rows of with_cache met each entry; entries that none met have 0."""
    hits = rows.filter("hit").groupBy("hash").agg(F.count(F.lit(1)).alias("hits"))
    return cache.select("hash").join(hits, "hash", "left").select("hash", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def exported(rows: DataFrame) -> DataFrame:
    """Bodies as JSON values where they are JSON, else as strings: what a JSONL export writes."""
    body = F.coalesce(F.to_json(F.try_parse_json("request_body")), F.regexp_extract(F.to_json(F.array("request_body")), r"(?s)^\[(.*)\]$", 1))
    return rows.withColumn("request_body", body)
