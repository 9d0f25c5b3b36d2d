"""Hook, gate and transcript queries, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import ctx, hooks
from trailmark.plans.ctx import _READS, reads
from trailmark.sources import transcripts
from trailmark.sources.adapters import REQUESTS, requests, table

_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit", "Read")


def calls(spark, sf_dir):
    """A write, an edit of the first five characters, two edits of which one fits, a cell and a read, for each text in turn."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tool = F.element_at(F.array(*[F.lit(t) for t in _TOOLS]), (F.col("doc_id") % 5 + 1).cast("int"))
    head = F.left("text", F.lit(5))
    edits = F.array(
        F.struct(head.alias("old_string"), F.lit("<X>").alias("new_string"), (F.col("doc_id") % 2 == 0).alias("replace_all")),
        F.struct(F.lit("§ nowhere").alias("old_string"), F.lit("Y").alias("new_string"), F.lit(False).alias("replace_all")),
    )
    entry = F.to_json(F.struct(F.col("text").alias("content"), head.alias("old_string"), F.lit("<X>").alias("new_string"), (F.col("doc_id") % 2 == 0).alias("replace_all"), F.lit("cell").alias("new_source"), edits.alias("edits")))
    return d.select("doc_id", "text", tool.alias("tool"), entry.alias("tool_input"))


def writes(spark, sf_dir):
    c = calls(spark, sf_dir)
    content = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    return c.select("doc_id", F.md5(hooks.write_content(F.col("tool"), F.col("tool_input"))).alias("written"), F.md5(hooks.preview(F.col("tool"), F.col("tool_input"), content)).alias("preview"))


_WRITES = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 5 AS t FROM documents),
w AS (SELECT *, CASE t WHEN 0 THEN text WHEN 1 THEN '<X>' WHEN 2 THEN '<X>' || chr(10) || 'Y' || chr(10) WHEN 3 THEN 'cell' ELSE '' END AS written FROM d)
SELECT doc_id, md5(written) AS written, md5(CASE WHEN t IN (1, 2) AND doc_id % 3 <> 0 AND text <> '' THEN
  CASE WHEN doc_id % 2 = 0 THEN replace(text, left(text, 5), '<X>') ELSE '<X>' || substr(text, 6) END ELSE written END) AS preview FROM w"""


def bodies(spark, sf_dir):
    r = requests(spark, sf_dir)
    env = F.when(F.col("k") % 3 != 0, F.map_from_arrays(F.array(F.lit("Z_TOKEN"), F.concat(F.lit("A"), F.col("k").cast("string"))), F.array(F.lit("secret"), F.lit("value"))))
    return r.select("id", hooks.clean_body(F.concat(F.lit("make t"), F.col("k").cast("string")), F.when(F.col("k") % 2 == 0, F.col("cwd")), F.lit(None).cast("string"), F.col("backend"), env).alias("body"))


def outputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", "text", (F.col("doc_id") % 3).alias("code"), (F.col("doc_id") % 90).alias("original"), (F.col("doc_id") % 41).alias("compressed"))


def exits(spark, sf_dir):
    x = hooks.with_exit(F.col("text"), F.col("code"), F.col("original"), F.col("compressed"))
    return outputs(spark, sf_dir).select("doc_id", x.alias("x")).select("doc_id", F.md5("x.output").alias("output"), F.col("x.original").cast("long").alias("original"), F.col("x.compressed").cast("long").alias("compressed"), F.col("x.saved").cast("long").alias("saved"))


def captures(spark, sf_dir):
    """Three words stand for the shortened output."""
    short = F.concat(F.lit("kept "), F.col("code").cast("string"), F.lit(" lines \n"))
    x = hooks.replacement(short, F.col("original"), F.col("compressed"), F.when(F.col("doc_id") % 2 == 0, F.col("code")))
    return outputs(spark, sf_dir).select("doc_id", x.alias("x")).filter("x is not null").select("doc_id", "x.output", F.col("x.sent").cast("long").alias("sent"), F.col("x.saved").cast("long").alias("saved"))


_CAPTURES = """WITH o AS (SELECT doc_id, doc_id % 3 AS code, doc_id % 90 AS original, doc_id % 41 AS compressed, doc_id % 2 = 0 AS told FROM documents),
t AS (SELECT *, '[trailmark: compressed Bash output' || CASE WHEN told THEN ', exit ' || code ELSE '' END || '; ' || original || '->' || compressed || ' tokens]' || chr(10) || 'kept ' || code || ' lines'
  || CASE WHEN told AND code <> 0 THEN chr(10) || '[exit: ' || code || ']' ELSE '' END AS output,
  CAST(floor((9 + CASE WHEN told THEN 2 ELSE 0 END + CASE WHEN told AND code <> 0 THEN 2 ELSE 0 END) * 1.5) AS BIGINT) AS sent FROM o)
SELECT doc_id, output, sent, original - sent AS saved FROM t WHERE compressed < original AND sent < original"""


def stored(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    head = F.lit('{"a":1}')
    return hooks.detail(d.select(F.col("doc_id").alias("id"), ctx.encoded(F.col("text")).alias("request_body"), F.col("text").alias("response_body"), head.alias("request_headers"), F.lit(None).cast("string").alias("response_headers")))


def logged(spark, sf_dir):
    r = requests(spark, sf_dir).filter("k % 4 > 0")
    one = F.transform(F.sequence(F.lit(1), F.col("k") % 4), lambda i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("pattern_name"), F.lit("regex").alias("pattern_type"), F.concat(F.lit("v"), (F.col("k") * i).cast("string")).alias("original_value"), i.alias("message_index")))
    return hooks.detection_rows(r.select(F.col("id").alias("request_id"), "timestamp", one.alias("detections")))


def logged_calls(spark, sf_dir):
    r = requests(spark, sf_dir)
    one = F.array(F.struct(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.col("tool_name").alias("name"), F.col("request_body").alias("input")))
    return hooks.tool_call_rows(r.select(F.col("id").alias("request_id"), F.when(F.col("tool_name").isNotNull(), one).alias("tool_calls")))


def symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(F.lit("import"), F.lit("function"), F.lit("class")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = p.select(F.lit("/p").alias("cwd"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("file_path"), kind.alias("kind"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("source"), F.col("p_partkey").alias("line"))
    return hooks.symbol_view(rows).select("cwd", "file_path", "part", "kind", F.array_join("names", ",").alias("names"), "first_line")


def gated(spark, sf_dir):
    r = reads(spark, sf_dir).withColumns({"path": F.concat(F.lit("/p/src/"), F.col("path")), "lines": F.col("id") % 100, "tokens": F.col("tokens")})
    return hooks.read_gate(r)


def cleared(spark, sf_dir):
    starts = requests(spark, sf_dir).filter("endpoint_name = 'AgentPrompt' and k % 5 = 0").select("session_id", F.col("timestamp").alias("read_at"), "id")
    return hooks.since_start(reads(spark, sf_dir), starts).select("id", "session_id", "hit", "sent")


def transcript_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    usage = F.when(F.col("role") == "assistant", F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("input_tokens"), F.col("turn").alias("output_tokens")))
    message = F.struct(F.when(F.col("turn") % 2 == 1, F.concat(F.lit("m"), (F.col("turn") % 4).cast("string"))).alias("model"), F.when(F.col("role") == "assistant", F.lit("end")).alias("stop_reason"), usage.alias("usage"))
    return c.select(F.col("conv_id").alias("id"), F.struct(F.lit(0).alias("part"), F.col("turn").alias("line")).alias("at"), F.to_json(F.struct(F.col("role").alias("type"), message.alias("message"))).alias("value"))


_TRANSCRIPTS = """WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY 1),
s AS (SELECT conv_id, max(turn) AS stop FROM conversations c JOIN l USING (conv_id) WHERE role = 'user' AND turn < last GROUP BY 1)
SELECT conv_id AS id, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens,
  arg_max('m' || (turn % 4), turn) FILTER (turn % 2 = 1) AS model, 'end' AS stop_reason
FROM conversations JOIN l USING (conv_id) LEFT JOIN s USING (conv_id) WHERE role = 'assistant' AND (stop IS NULL OR turn > stop) GROUP BY 1"""


def routes(spark, sf_dir):
    r = requests(spark, sf_dir)
    turn = F.when(F.col("k") % 3 == 0, F.lit("")).when(F.col("k") % 3 == 1, F.col("session_id"))
    route = hooks.stop_route(turn, F.when(F.col("id") % 2 == 0, F.col("output_tokens")), F.when(F.col("k") % 5 != 0, F.col("response_body")))
    return r.select("id", hooks.marker(F.col("session_id"), "end").alias("marker"), route.alias("x")).select("id", "marker", "x.kind", F.col("x.tokens").cast("long").alias("tokens"))


def ranges(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(hooks.line_ranges(F.coalesce("text", F.lit("")), F.lit("2-3, 1,x,500-,7-5"))).alias("shown"))


_RANGES = """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\n$', '') AS body, string_split(regexp_replace(coalesce(text, ''), '\\n$', ''), chr(10)) AS all_lines, coalesce(text, '') = '' AS none FROM documents),
l AS (SELECT doc_id, CASE WHEN none THEN [] ELSE list_transform(all_lines, lambda x: regexp_replace(x, '\\r$', '')) END AS lines FROM d),
p AS (SELECT doc_id, lines, list_filter(list_concat([2, 3, 1], range(500, len(lines) + 1)), lambda i: i <= len(lines)) AS picked FROM l)
SELECT doc_id, md5(CASE WHEN len(picked) > 0 THEN array_to_string(list_transform(picked, lambda i: printf('%4d| ', i) || lines[i]), chr(10)) ELSE 'No lines matched the range.' END) AS shown FROM p"""


def replaced(spark, sf_dir):
    """Every fifth file is read again: of its symbols those of even keys are left, one line below."""
    p = table(spark, sf_dir, "part").select(F.lit("/p").alias("cwd"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("file_path"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"), "p_size")
    again = p.filter("p_size % 5 = 0")
    found = again.filter("line % 2 = 0").withColumn("line", F.col("line") + 1)
    return hooks.replaced_symbols(p.drop("p_size"), found.drop("p_size"), again)


def command_files(spark, sf_dir):
    r = requests(spark, sf_dir).filter("tool_name = 'Bash'")
    commands = r.select("id", F.concat(F.lit("cat -n 'src/f"), (F.col("k") % 12).cast("string"), F.lit(".py' other.txt | head")).alias("command"))
    files = r.select(F.concat(F.lit("src/f"), (F.col("k") % 6).cast("string"), F.lit(".py")).alias("path")).distinct()
    return hooks.existing_paths(commands, files)


PLANS = {
    "snk3_replaced_symbols": (
        replaced,
        "SELECT '/p' AS cwd, 'f' || p_size AS file_path, p_name AS name, CASE WHEN p_size % 5 = 0 THEN p_partkey + 1 ELSE p_partkey END AS line FROM part WHERE p_size % 5 <> 0 OR p_partkey % 2 = 0",
    ),
    "sym2_command_files": (
        command_files,
        f"WITH {REQUESTS} SELECT id, 'src/f' || (k % 12) || '.py' AS path FROM requests WHERE tool_name = 'Bash' AND k % 12 IN (SELECT k % 6 FROM requests WHERE tool_name = 'Bash')",
    ),
    "dlp18_written_contents": (writes, _WRITES),
    "dlp19_clean_bodies": (
        bodies,
        f"""WITH {REQUESTS} SELECT id, '{{"backend":"' || backend || '","command":"make t' || k || '","cwd":' || CASE WHEN k % 2 = 0 THEN '"' || cwd || '"' ELSE 'null' END || ',"env_keys":[' || CASE WHEN k % 3 <> 0 THEN '"A' || k || '","Z_TOKEN"' ELSE '' END || '],"shell":null}}' AS body FROM requests""",
    ),
    "cmp16_exit_codes": (
        exits,
        """SELECT doc_id, md5(CASE WHEN code = 0 THEN text ELSE text || CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN chr(10) ELSE '' END || '[exit: ' || code || ']' END) AS output,
        original + CASE WHEN code = 0 THEN 0 ELSE 3 END AS original, compressed + CASE WHEN code = 0 THEN 0 ELSE 3 END AS compressed, greatest(original - compressed, 0) AS saved
        FROM (SELECT doc_id, coalesce(text, '') AS text, doc_id % 3 AS code, doc_id % 90 AS original, doc_id % 41 AS compressed FROM documents)""",
    ),
    "cmp15_captured_outputs": (captures, _CAPTURES),
    "prj3_detail": (stored, "SELECT doc_id AS id, text AS request_body, text AS response_body, '{\"a\":1}' AS request_headers, CAST(NULL AS VARCHAR) AS response_headers FROM documents"),
    "snk2_detection_rows": (
        logged,
        f"""WITH {REQUESTS} SELECT id AS request_id, "timestamp", 'p' || i AS pattern_name, 'regex' AS pattern_type, 'v' || (k * i) AS original_value, '' AS placeholder, i AS message_index
        FROM (SELECT *, unnest(range(1, k % 4 + 1)) AS i FROM requests WHERE k % 4 > 0)""",
    ),
    "snk2_tool_call_rows": (logged_calls, f"WITH {REQUESTS} SELECT id AS request_id, 'c' || id AS tool_call_id, tool_name, request_body AS tool_input FROM requests WHERE tool_name IS NOT NULL"),
    "sym3_symbol_view": (
        symbols,
        """SELECT '/p' AS cwd, 'f' || p_size AS file_path, CASE WHEN p_partkey % 3 = 0 THEN 'imports' ELSE 'definitions' END AS part, ['import', 'function', 'class'][p_partkey % 3 + 1] AS kind,
        string_agg('n' || p_partkey, ',' ORDER BY p_partkey) AS names, min(p_partkey) AS first_line FROM part GROUP BY 1, 2, 3, 4""",
    ),
    "ctx5_line_ranges": (ranges, _RANGES),
    "ctx7_read_gate": (
        gated,
        f"""WITH {_READS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY read_at, id) - 1 AS before FROM hits)
        SELECT id, CASE WHEN hit THEN 200 ELSE 204 END AS status, CASE WHEN hit THEN ref || '=' || path || ' cached ' || before || 't ' || (id % 100) || 'L' END AS stub, CASE WHEN hit THEN greatest(tokens - 6, 0) ELSE 0 END AS saved FROM n""",
    ),
    "src5_transcript_usage": (lambda s, d: transcripts.last_usage(transcript_lines(s, d)), _TRANSCRIPTS),
    "str6_stop_routes": (
        routes,
        f"""WITH {REQUESTS} SELECT id, session_id || ':end' AS marker, CASE WHEN k % 3 = 1 THEN 'output' ELSE 'close' END || CASE WHEN id % 2 = 0 THEN '_usage' ELSE '' END AS kind,
        CAST(CASE WHEN id % 2 = 0 THEN output_tokens WHEN k % 5 <> 0 THEN 6 ELSE 0 END AS BIGINT) AS tokens FROM requests""",
    ),
    "str9_cleared_cache": (
        cleared,
        f"""WITH {REQUESTS}, m AS (SELECT session_id, file_path AS path, "timestamp" AS read_at, id, k % 2 AS hash, input_tokens AS tokens, tool_name = 'Read' AS is_read,
          sum(CASE WHEN endpoint_name = 'AgentPrompt' AND k % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY "timestamp", id ROWS UNBOUNDED PRECEDING) AS epoch FROM requests),
        h AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY session_id, epoch, path ORDER BY read_at, id) = hash, false) AS hit FROM m WHERE is_read)
        SELECT id, session_id, hit, CASE WHEN hit THEN 0 ELSE tokens END AS sent FROM h""",
    ),
}
