"""How sessions go: which tool calls belong to which prompt, what was read before it was written, and the ratios of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators import filters as flt

READS, WRITES = ("read", "glob", "grep"), ("write", "edit", "notebookedit")


def turns(r: DataFrame) -> DataFrame:
    """Tool rows with the prompt they belong to (as-of join): the last prompt of the session at or before them.

    One sort of each session answers both questions: prompts come before tools of the same time, and the last
    prompt's id runs along; the same order tells whether the file of a write was read before. Tools before the first
    prompt and tools without a name are left out."""
    kind = F.when(flt.prompts(), 0).otherwise(1)
    rows = r.filter((F.col("session_id") != "") & (flt.prompts() | (F.coalesce("tool_name", F.lit("")) != ""))).withColumn("kind", kind)
    so_far = Window.partitionBy("session_id").orderBy("timestamp", "kind", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("prompt_id", F.last(F.when(F.col("kind") == 0, F.col("id")), ignorenulls=True).over(so_far))
    tools = rows.filter("kind = 1 and prompt_id is not null")
    tool, path = F.lower("tool_name"), F.coalesce("file_path", F.lit(""))
    is_read, is_write = tool.isin(*READS) & (path != ""), tool.isin(*WRITES) & (path != "")
    by_file = Window.partitionBy("session_id", "file_path").orderBy("timestamp", "kind", "id").rowsBetween(Window.unboundedPreceding, -1)
    tools = tools.withColumns({"is_read": is_read.cast("int"), "is_write": is_write.cast("int")})
    return tools.withColumn("read_before", F.coalesce(F.max("is_read").over(by_file), F.lit(0)) * F.col("is_write"))


def sessions(r: DataFrame) -> DataFrame:
    """One row for each session with a prompt: 18 measures."""
    tool = F.lower("tool_name")
    explore = F.count_if(tool.isin("read", "grep", "glob"))
    modify = F.count_if(tool.isin("write", "edit", "bash", "notebookedit"))
    by_tools = turns(r).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("tools"),
        explore.alias("explore"),
        modify.alias("modify"),
        F.count_if(tool == "bash").alias("bash"),
        F.sum("is_read").alias("files_read"),
        F.count_distinct(F.when(F.col("is_read") == 1, F.col("file_path"))).alias("unique_files_read"),
        F.sum("is_write").alias("files_written"),
        F.count_distinct(F.when(F.col("is_write") == 1, F.col("file_path"))).alias("unique_files_written"),
        F.sum("read_before").alias("read_first"),
    )
    by_prompts = r.filter(flt.prompts() & (F.col("session_id") != "")).groupBy("session_id").agg(
        F.min_by("backend", F.struct("timestamp", "id")).alias("backend"),
        F.min_by(F.when(F.col("cwd") != "", F.col("cwd")), F.when(F.col("cwd") != "", F.struct("timestamp", "id"))).alias("cwd"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("turns"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens")],
        F.count_if(F.col("dlp_action") >= 2).alias("blocked"),
    )
    both = by_prompts.join(by_tools, "session_id", "left").fillna(0, subset=["tools", "explore", "modify", "bash", "files_read", "unique_files_read", "files_written", "unique_files_written", "read_first"])
    ratio = F.when(F.col("modify") == 0, F.col("explore").cast("double")).otherwise(F.col("explore") / F.nullif("modify", F.lit(0)))
    first = F.when(F.col("files_written") == 0, F.lit(100.0)).otherwise(F.try_divide(F.col("read_first") * 100.0, F.col("files_written")))
    return both.withColumns({
        "display_name": F.element_at(F.split("cwd", "/"), -1),
        "duration_ms": F.greatest(F.timestamp_diff("MILLISECOND", F.col("first_seen"), F.col("last_seen")), F.lit(0)),
        "read_first_pct": F.round(first, 4),
        "exploration": F.round(ratio, 4),
    })


def overall(s: DataFrame) -> DataFrame:
    """Unweighted means over sessions."""
    return s.agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("turns"), 3).alias("turns"), F.round(F.avg("read_first_pct"), 3).alias("read_first_pct"), F.round(F.avg("exploration"), 3).alias("exploration"))


def weighted(s: DataFrame, *by: Column) -> DataFrame:
    """Ratios over all calls of the sessions: reads before writes weigh by writes; null where there is nothing to relate."""
    explore, rest = F.sum("explore"), F.sum("modify")
    return s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.round(F.try_divide(F.sum("read_first") * 100.0, F.sum("files_written")), 3).alias("read_first_pct"),
        F.round(F.when(rest > 0, explore / F.nullif(rest, F.lit(0))).when(explore > 0, explore.cast("double")), 3).alias("exploration"),
        F.round(F.try_divide(F.sum("bash") * 100.0, F.sum("tools")), 3).alias("bash_pct"),
        F.round(F.try_divide(F.sum("tools") * 1.0, F.sum("turns")), 3).alias("tempo"),
        F.count_distinct(F.coalesce(F.nullif("cwd", F.lit("")), F.nullif("display_name", F.lit("")), F.col("session_id"))).alias("projects"),
        F.count_if(F.col("blocked") > 0).alias("blocked_sessions"),
        F.sum("blocked").alias("blocked_turns"),
    )


def tool_mix(s: DataFrame) -> DataFrame:
    """kind, n, pct: explore, modify (without bash), bash and other calls."""
    total = F.sum("tools")
    counts = s.agg(F.sum("explore").alias("explore"), (F.sum("modify") - F.sum("bash")).alias("modify"), F.sum("bash").alias("bash"), (total - F.sum("explore") - F.sum("modify")).alias("other"), total.alias("total"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("explore", "modify", "bash", "other")]))
    return counts.select(kinds.alias("x"), "total").select("x.kind", "x.n", F.round(F.try_divide(F.col("x.n") * 100.0, F.col("total")), 3).alias("pct"))


def _band(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNull(), F.lit("none")).when(value >= high, F.lit("high")).when(value >= low, F.lit("mid")).otherwise(F.lit("low"))


def flags(s: DataFrame, most: int = 4) -> DataFrame:
    """session_id and its flags by priority, joined; bands of the four ratios."""
    writes = F.col("files_written") > 0
    bash = F.try_divide(F.col("bash") * 100.0, F.col("tools"))
    tempo = F.try_divide(F.col("tools") * 1.0, F.col("turns"))
    found = F.array(
        F.when(F.col("blocked") > 0, F.lit("blocked")),
        F.when(writes & (F.col("read_first_pct") >= 85), F.lit("read-first")).when(writes & (F.col("read_first_pct") < 60), F.lit("edit-first")),
        F.when(bash >= 30, F.lit("bash-heavy")),
        F.when(F.col("exploration") >= 2.5, F.lit("deep-scan")).when(writes & (F.col("exploration") < 0.8), F.lit("low-explore")),
        F.when(tempo >= 4.5, F.lit("high-tempo")),
    )
    return s.select(
        "session_id",
        F.array_join(F.slice(F.array_compact(found), 1, most), ",").alias("flags"),
        _band(F.when(writes, F.col("read_first_pct")), 70, 85).alias("read_band"),
        _band(F.col("exploration"), 1, 2.5).alias("explore_band"),
        _band(bash, 15, 30).alias("bash_band"),
        _band(tempo, 2.5, 4.5).alias("tempo_band"),
    )
