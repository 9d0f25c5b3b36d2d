"""What hooks make of their payloads: written contents, edit previews, clean bodies, accounting, gates, routes of stop events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.ctx import cache_hits, decoded
from trailmark.operators.dlp import estimated_tokens
from trailmark.operators.stats import path_tokens

EDITS = "array<struct<old_string:string,new_string:string,replace_all:boolean>>"


def _text(tool_input: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(tool_input, f"$.{key}"), F.lit(""))


def _edits(tool_input: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(tool_input, "$.edits"), EDITS), F.array().cast(EDITS))


def write_content(tool: Column, tool_input: Column) -> Column:
    """The text that a call writes: a content, a new string, all new strings (a line break after each), a cell's source; else empty."""
    many = F.array_join(F.transform(F.filter(_edits(tool_input), lambda e: e["new_string"].isNotNull()), lambda e: F.concat(e["new_string"], F.lit("\n"))), "")
    out = F.when(tool == "Write", _text(tool_input, "content")).when(tool == "Edit", _text(tool_input, "new_string"))
    return out.when(tool == "MultiEdit", many).when(tool == "NotebookEdit", _text(tool_input, "new_source")).otherwise(F.lit(""))


def _edit(state: Column, old: Column, new: Column, everywhere: Column) -> Column:
    """state (text, any) after one edit; an empty or absent old string changes nothing."""
    at = F.position(old, state["text"])
    once = F.concat(F.substring(state["text"], F.lit(1), at - 1), new, F.substring(state["text"], at + F.length(old), F.length(state["text"])))
    changed = F.when(everywhere, F.replace(state["text"], old, new)).otherwise(once)
    return F.when((old == "") | (at == 0), state).otherwise(F.struct(changed.alias("text"), F.lit(True).alias("any")))


def preview(tool: Column, tool_input: Column, content: Column) -> Column:
    """A file as it would be after the call: edits are applied to its content; without a file (null) or any edit that
    fits, the written text alone."""
    begin = F.struct(content.alias("text"), F.lit(False).alias("any"))
    single = F.array(F.struct(_text(tool_input, "old_string").alias("old_string"), _text(tool_input, "new_string").alias("new_string"), F.coalesce(F.get_json_object(tool_input, "$.replace_all") == "true", F.lit(False)).alias("replace_all")))
    edits = F.when(tool == "Edit", single).when(tool == "MultiEdit", _edits(tool_input))
    blank = F.lit("")
    done = F.aggregate(edits, begin, lambda s, e: _edit(s, F.coalesce(e["old_string"], blank), F.coalesce(e["new_string"], blank), F.coalesce(e["replace_all"], F.lit(False))))
    return F.when(content.isNotNull() & F.coalesce(done["any"], F.lit(False)), done["text"]).otherwise(write_content(tool, tool_input))


def clean_body(command: Column, cwd: Column, shell: Column, backend: Column, env: Column) -> Column:
    """The logged body of a command request as JSON: the names of its variables in order, never their values."""
    names = F.coalesce(F.array_sort(F.map_keys(env)), F.array().cast("array<string>"))
    return F.to_json(F.struct(backend.alias("backend"), command.alias("command"), cwd.alias("cwd"), names.alias("env_keys"), shell.alias("shell")), {"ignoreNullFields": "false"})


def with_exit(output: Column, code: Column, original: Column, compressed: Column) -> Column:
    """output, original, compressed, saved: a failing command's output ends with its exit code, whose tokens count on both sides."""
    suffix = F.concat(F.when((output != "") & ~F.endswith(output, F.lit("\n")), F.lit("\n")).otherwise(F.lit("")), F.lit("[exit: "), code.cast("string"), F.lit("]"))
    suffix = F.when(code != 0, suffix).otherwise(F.lit(""))
    more = estimated_tokens(suffix)
    return F.struct(F.concat(output, suffix).alias("output"), (original + more).alias("original"), (compressed + more).alias("compressed"), F.greatest(original - compressed, F.lit(0)).alias("saved"))


def replacement(output: Column, original: Column, compressed: Column, code: Column, label: str = "trailmark") -> Column:
    """output, sent, saved of a shortened capture under its banner; null if that is not shorter than the original in the end."""
    banner = F.concat(F.lit(f"[{label}: compressed Bash output"), F.coalesce(F.concat(F.lit(", exit "), code.cast("string")), F.lit("")), F.lit("; "), original.cast("string"), F.lit("->"), compressed.cast("string"), F.lit(" tokens]\n"))
    text = F.concat(banner, F.regexp_replace(output, r"\s+$", ""))
    text = F.concat(text, F.when((code != 0) & ~F.contains(text, F.lit("[exit:")), F.concat(F.lit("\n[exit: "), code.cast("string"), F.lit("]"))).otherwise(F.lit("")))
    sent = estimated_tokens(text)
    fits = output.rlike(r"\S") & (compressed < original) & (sent < original)
    return F.when(fits, F.struct(text.alias("output"), sent.alias("sent"), (original - sent).alias("saved")))


def detail(rows: DataFrame) -> DataFrame:
    """One request in full: stored bodies and headers are decoded."""
    return rows.select("id", *[decoded(F.col(c)).alias(c) for c in ("request_body", "response_body", "request_headers", "response_headers")])


def detection_rows(found: DataFrame) -> DataFrame:
    """found (request_id, timestamp, detections: array of pattern_name, pattern_type, original_value, message_index) as
    the rows to append, one for each detection, with no placeholder."""
    each = found.select("request_id", "timestamp", F.explode("detections").alias("d"))
    return each.select("request_id", "timestamp", "d.pattern_name", "d.pattern_type", "d.original_value", F.lit("").alias("placeholder"), "d.message_index")


def tool_call_rows(found: DataFrame) -> DataFrame:
    """found (request_id, tool_calls: array of id, name, input) as the rows to append; requests without calls add none."""
    each = found.select("request_id", F.explode("tool_calls").alias("c"))
    return each.select("request_id", F.col("c.id").alias("tool_call_id"), F.col("c.name").alias("tool_name"), F.col("c.input").alias("tool_input"))


def append(rows: DataFrame, table: str) -> None:
    """Adds rows to a table; the write is one job, committed as a whole."""
    rows.write.mode("append").saveAsTable(table)


def symbol_view(symbols: DataFrame) -> DataFrame:
    """symbols (cwd, file_path, kind, name, source, line) by file and kind: their names in order of line; imports and definitions apart."""
    part = F.when(F.col("kind") == "import", F.lit("imports")).otherwise(F.lit("definitions"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda s: s["name"])
    return symbols.groupBy("cwd", "file_path", part.alias("part"), "kind").agg(listed.alias("names"), F.min("line").alias("first_line"))


def lines_of(text: Column) -> Column:
    """Lines without their ends; a last line break begins no line."""
    parts = F.split(text, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))


def line_ranges(text: Column, ranges: Column) -> Column:
    """The lines that `N-M,X` names, numbered, in the order named. An unreadable start is 1, an unreadable end the last line."""
    lines = lines_of(text)
    total = F.size(lines)

    def number(part: Column, otherwise: Column) -> Column:
        part = F.trim(part)
        return F.coalesce(F.when(part.rlike(r"^\+?[0-9]+$"), F.replace(part, F.lit("+"), F.lit("")).try_cast("long")), otherwise)

    def places(part: Column) -> Column:
        dash = F.position(F.lit("-"), part)
        one = number(part, F.lit(0).cast("long"))
        begin = F.when(dash > 0, F.greatest(number(F.substring(part, F.lit(1), dash - 1), F.lit(1).cast("long")), F.lit(1).cast("long"))).otherwise(one)
        end = F.when(dash > 0, F.least(number(F.substring(part, dash + 1, F.length(part)), total.cast("long")), total.cast("long"))).otherwise(one)
        return F.when((begin >= 1) & (begin <= end) & (end <= total), F.sequence(begin, F.greatest(begin, end))).otherwise(F.array().cast("array<bigint>"))

    picked = F.flatten(F.transform(F.split(ranges, ","), lambda p: places(F.trim(p))))
    shown = F.transform(picked, lambda i: F.format_string("%4d| %s", i, F.element_at(lines, i.cast("int"))))
    return F.when(F.size(picked) > 0, F.array_join(shown, "\n")).otherwise(F.lit("No lines matched the range."))


def read_gate(reads: DataFrame) -> DataFrame:
    """reads of cache_hits with `lines`: status 200 and a stub for a file that did not change, else 204 and nothing. The
    stub names the reference, the base name, the reads so far (this one not counted) and the lines."""
    before = F.row_number().over(Window.partitionBy("session_id", "path").orderBy("read_at", "id")) - 1
    base = F.element_at(F.split("path", "/"), -1)
    stub = F.concat("ref", F.lit("="), base, F.lit(" cached "), before.cast("string"), F.lit("t "), F.col("lines").cast("string"), F.lit("L"))
    rows = cache_hits(reads).withColumn("stub", F.when(F.col("hit"), stub))
    saved = F.when(F.col("hit"), F.greatest(F.col("tokens") - estimated_tokens(F.col("stub")), F.lit(0))).otherwise(F.lit(0))
    return rows.select("id", F.when(F.col("hit"), F.lit(200)).otherwise(F.lit(204)).alias("status"), "stub", saved.alias("saved"))


def since_start(reads: DataFrame, starts: DataFrame) -> DataFrame:
    """cache_hits where a session's start (session_id, read_at, id) clears its cache: reads meet only reads since then."""
    marks = reads.withColumn("starts", F.lit(0)).unionByName(starts.select("session_id", "read_at", "id").withColumn("starts", F.lit(1)), allowMissingColumns=True)
    epoch = F.sum("starts").over(Window.partitionBy("session_id").orderBy("read_at", "id").rowsBetween(Window.unboundedPreceding, 0))
    own = marks.withColumn("epoch", epoch).filter("starts = 0").drop("starts")
    own = own.withColumn("session", F.col("session_id")).withColumn("session_id", F.concat_ws("#", "session_id", "epoch"))
    return cache_hits(own).withColumn("session_id", F.col("session")).drop("session")


def marker(session: Column, which: str) -> Column:
    """The correlation id of a session's start or end row, apart from that of its prompts."""
    return F.concat(session, F.lit(f":{which}"))


def stop_route(turn_id: Column, output_tokens: Column, message: Column) -> Column:
    """kind and tokens of a stop event: the row of its turn if that is known, else the session's open one; the usage
    that the transcript tells replaces, an estimate of the last message adds."""
    turn = F.coalesce(turn_id, F.lit("")) != ""
    kind = F.concat(F.when(turn, F.lit("output")).otherwise(F.lit("close")), F.when(output_tokens.isNotNull(), F.lit("_usage")).otherwise(F.lit("")))
    return F.struct(kind.alias("kind"), F.coalesce(output_tokens, estimated_tokens(F.coalesce(message, F.lit("")))).alias("tokens"))


def replaced_symbols(stored: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    """stored with all rows of the files (cwd, file_path) replaced by found: a file without symbols left has none."""
    return stored.join(files.select("cwd", "file_path").distinct(), ["cwd", "file_path"], "left_anti").unionByName(found)


def existing_paths(commands: DataFrame, files: DataFrame) -> DataFrame:
    """commands (id, command) to id, path: the paths named in a command that are files (path)."""
    named = commands.select("id", F.explode(path_tokens(F.col("command"))).alias("path"))
    return named.join(files.select("path"), "path", "left_semi").select("id", "path")
