"""Dashboards and logs over `requests`: each a plan over one scan where the numbers allow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators import filters as flt


def _sum(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def tray(r: DataFrame) -> DataFrame:
    """The last day by backend."""
    cache = F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    day = r.filter(flt.since(flt.clock(r), "1d"))
    return day.groupBy("backend").agg(F.count(F.lit(1)).alias("n"), _sum("input_tokens").alias("input_tokens"), _sum("output_tokens").alias("output_tokens"), _sum(cache).alias("cache_tokens"))


def models(r: DataFrame) -> DataFrame:
    return r.filter("model is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def overview(r: DataFrame) -> DataFrame:
    """All global numbers of the dashboard in one pass: features, tokens, count, mean positive latency, cache hits."""
    return r.agg(
        F.count(F.lit(1)).alias("n"),
        *[_sum(c).cast("long").alias(c) for c in ("has_system_prompt", "has_tools", "has_thinking")],
        *[_sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")],
        F.round(F.coalesce(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0.0)), 4).alias("avg_latency_ms"),
        F.round(F.coalesce(F.avg(F.when(F.col("cache_read_tokens") > 0, 100.0).otherwise(0.0)), F.lit(0.0)), 4).alias("cache_hit_pct"),
    )


def facts(r: DataFrame) -> DataFrame:
    """The home page's facts, one row: windows of an hour, a day and a week as conditional aggregates of one pass; the top
    model and tool from a second, grouped one."""
    now = flt.clock(r)
    hour, day, week = (flt.since(now, x) for x in ("1h", "1d", "7d"))
    one = r.agg(
        F.count_if(hour).alias("last_hour"),
        F.count_if(day).alias("last_day"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.when(day, F.col("tokens_saved"))), F.lit(0)).alias("saved_day"),
        F.round(F.coalesce(F.avg(F.when(day & (F.col("latency_ms") > 0), F.col("latency_ms"))), F.lit(0.0)), 4).alias("avg_latency_day"),
        F.count_if(week & (F.col("dlp_action") > 0)).alias("flagged_week"),
        F.max(F.when(F.col("backend") == "hooks-a", F.col("timestamp"))).alias("last_a"),
    )

    def top(column: str) -> DataFrame:
        found = r.filter(week & F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return found.agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(f"top_{column}"))

    return one.join(F.broadcast(top("model")), how="cross").join(F.broadcast(top("tool_name")), how="cross")


def choices(r: DataFrame, column: str) -> DataFrame:
    """Distinct values of a filter, null as 'unknown'."""
    return r.select(F.coalesce(column, F.lit("unknown")).alias(column)).distinct()


def logs(r: DataFrame, time_range="all", backend="all", model="all", action="all", search="", view="") -> DataFrame:
    """Rows of the log view that pass its filters."""
    return r.filter(flt.since(flt.clock(r), time_range) & flt.of_backend(backend) & flt.of_model(model) & flt.of_action(action) & flt.mentions(search) & flt.of_view(view))


#: Rows a page may have.
MOST_ROWS = 10_000


def page(rows: DataFrame, number: int = 0, size: int = 10) -> DataFrame:
    """One page, newest first; a top-k, not a full sort."""
    size = min(size, MOST_ROWS)
    return rows.orderBy(F.desc("id")).offset(number * size).limit(size)


def summaries(rows: DataFrame) -> DataFrame:
    """The log's columns; names come from the metadata or the request, reasons from the response, null where these are not JSON."""
    request, response = F.col("request_body"), F.col("response_body")
    decision = F.get_json_object(response, "$.decision")
    reason = F.coalesce(
        F.get_json_object(response, "$.hookSpecificOutput.permissionDecisionReason"),
        F.get_json_object(response, "$.hook_specific_output.permission_decision_reason"),
        F.get_json_object(response, "$.reason"),
        F.concat(F.lit("Decision: "), decision),
    )
    name = F.coalesce(F.get_json_object("extra_metadata", "$.tool_name"), F.get_json_object(request, "$.tool_name"), F.get_json_object(request, "$.toolName"))
    return rows.select("id", "timestamp", "backend", F.coalesce("model", F.lit("unknown")).alias("model"), name.alias("tool_name"), reason.alias("guardian_reason"), F.round(F.coalesce(F.try_divide(F.col("tokens_saved") * 100, F.col("input_tokens")), F.lit(0.0)), 1).alias("reduction_pct"))


def short_model(model: Column) -> Column:
    """family-version of names like claude-family-version; other names as they are."""
    return F.when(model.rlike(r"claude-\w+-\d+-\d+"), F.regexp_replace(model, r"claude-(\w+)-(\d+-\d+).*", "$1-$2")).otherwise(model)


def tool_usage(calls: DataFrame, r: DataFrame, n: int = 20) -> DataFrame:
    counts = calls.join(r.select("id"), calls.request_id == r.id).groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "tool_name").limit(n)


def target(tool: Column, tool_input: Column) -> Column:
    """What a call is about: a file's base name, the first word of a command, the first 20 characters of a pattern."""
    path = F.coalesce(F.get_json_object(tool_input, "$.file_path"), F.get_json_object(tool_input, "$.path"), F.get_json_object(tool_input, "$.notebook_path"))
    command = F.element_at(F.split(F.trim(F.get_json_object(tool_input, "$.command")), r"\s+"), 1)
    base = F.element_at(F.split(path, "/"), -1)
    kind = F.lower(tool)
    return F.when(kind.isin("read", "write", "edit", "notebookedit", "multiedit"), base).when(kind == "bash", command).when(kind.isin("grep", "glob"), F.left(F.get_json_object(tool_input, "$.pattern"), F.lit(20)))


def tool_insights(calls: DataFrame, tools: int = 8, targets: int = 5) -> DataFrame:
    """tool_name, target, n and the tool's count: the most frequent targets of the most frequent tools, and the rest as '(other)'."""
    found = calls.select("tool_name", target(F.col("tool_name"), F.col("tool_input")).alias("target"))
    by_target = found.groupBy("tool_name", "target").agg(F.count(F.lit(1)).alias("n"))
    by_tool = by_target.groupBy("tool_name").agg(F.sum("n").alias("tool_n")).orderBy(F.desc("tool_n"), "tool_name").limit(tools)
    rank = F.row_number().over(Window.partitionBy("tool_name").orderBy(F.desc("n"), "target"))
    kept = by_target.filter("target is not null").withColumn("rank", rank).filter(F.col("rank") <= targets).join(F.broadcast(by_tool), "tool_name")
    kept = kept.select("tool_name", "target", "n", "tool_n")
    rest = kept.groupBy("tool_name", "tool_n").agg((F.col("tool_n") - F.sum("n")).alias("n")).filter("n > 0")
    return kept.unionByName(rest.select("tool_name", F.lit("(other)").alias("target"), "n", "tool_n"))


def savings(r: DataFrame) -> DataFrame:
    """Saved tokens by the first key of the saving's metadata, in the order it is written; else 'unknown'."""
    keys = F.json_object_keys("token_saving_meta")
    method = F.coalesce(F.try_element_at(keys, F.lit(1)), F.lit("unknown"))
    return r.filter("tokens_saved > 0").groupBy(method.alias("method")).agg(F.sum("tokens_saved").alias("saved"), F.count(F.lit(1)).alias("n"))


def projects(r: DataFrame) -> DataFrame:
    """By working directory: tokens (input with both caches), cache reads, requests, last use, backends."""
    cwd = F.get_json_object("extra_metadata", "$.cwd")
    used = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    return r.withColumn("cwd", cwd).filter("cwd is not null and cwd != ''").groupBy("cwd").agg(_sum(used).alias("input_tokens"), _sum("output_tokens").alias("output_tokens"), _sum("cache_read_tokens").alias("cache_read"), F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_used"), F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"))


def path_tokens(command: Column) -> Column:
    """Words of a command that look like paths, each once: quotes trimmed, no flags, no shell operators or wildcards, with a
    slash or an extension of one to six letters or digits."""
    words = F.transform(F.split(command, r"\s+"), lambda w: F.regexp_replace(w, "^['\"]+|['\"]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.startswith("-") & ~w.rlike(r"[|&;<>`$*?]") & (w.contains("/") | w.rlike(r"\.[A-Za-z0-9]{1,6}$"))))


def touches(r: DataFrame, calls: DataFrame) -> DataFrame:
    """path, n, backends, last_used: touches from the metadata, from tool inputs and from paths in commands, all counted."""
    base = r.select("id", "backend", "timestamp", "file_path")
    one = base.filter("file_path is not null").select("backend", "timestamp", F.col("file_path").alias("path"))
    joined = calls.join(base.drop("file_path"), calls.request_id == base.id)
    named = F.coalesce(*[F.get_json_object("tool_input", f"$.{k}") for k in ("file_path", "path", "notebook_path")])
    two = joined.select("backend", "timestamp", named.alias("path")).filter("path is not null")
    three = joined.filter(F.lower("tool_name") == "bash").select("backend", "timestamp", F.explode(path_tokens(F.get_json_object("tool_input", "$.command"))).alias("path"))
    every = one.unionByName(two).unionByName(three)
    return every.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"), F.max("timestamp").alias("last_used"))


def ranked_files(touched: DataFrame, sizes: DataFrame, n: int = 200) -> DataFrame:
    """path, tokens, n, weight: files by tokens times touches, then tokens, then touches."""
    both = touched.join(sizes, "path", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    both = both.withColumn("weight", F.col("tokens") * F.greatest("n", F.lit(1)))
    return both.orderBy(F.desc("weight"), F.desc("tokens"), F.desc("n"), "path").limit(n).select("path", "tokens", "n", "weight")


def modules(files: DataFrame, n: int = 3) -> DataFrame:
    """module, weight, share: the heaviest first path segments and their share of all weight."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    top = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit("(root)"))
    weight = F.greatest("tokens", F.lit(1)) * F.greatest("n", F.lit(1))
    by = files.select(top.alias("module"), weight.alias("w")).groupBy("module").agg(F.sum("w").alias("weight"))
    share = F.round(F.col("weight") * 100.0 / F.sum("weight").over(Window.partitionBy(F.lit(0))), 4)  # one row for each module
    return by.withColumn("share", share).orderBy(F.desc("weight"), "module").limit(n)


def coins(projects: DataFrame) -> DataFrame:
    """gold for fresh input (100 000 tokens each), copper for cache reads (a million), 1 to 20 unless nothing is there."""

    def bucket(value: Column, unit: int) -> Column:
        n = F.round(value / unit).cast("long")
        return F.when(value <= 0, F.lit(0)).otherwise(F.least(F.greatest(n, F.lit(1)), F.lit(20))).cast("long")

    return projects.select("cwd", bucket(F.col("input_tokens") - F.col("cache_read"), 100_000).alias("gold"), bucket(F.col("cache_read"), 1_000_000).alias("copper"))
