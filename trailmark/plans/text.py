"""Output-summary queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import text as t
from trailmark.sources.adapters import table


def logs(spark, sf_dir):
    """Event streams of users as captured logs with repeated lines."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    line = F.concat(F.lit("[2024-01-01 00:00:00] "), F.when(k % 4 < 3, F.col("event_type")).otherwise(F.lit("request failed: error")))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


_LOGS = """ev AS (SELECT user_id, event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 < 3 THEN event_type ELSE 'request failed: error' END AS line FROM events),
runs AS (SELECT user_id, run, any_value(line) AS line, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(line) OVER (PARTITION BY user_id ORDER BY event_id) = line THEN 0 ELSE 1 END AS new FROM ev)) GROUP BY 1, 2)"""


def searches(spark, sf_dir):
    """Orders of a customer as search results: file:number:content."""
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.lit("src/f"), (F.col("o_orderkey") % 6).cast("string"), F.lit(".py:"), F.col("o_orderkey").cast("string"), F.lit(":"), F.when(F.col("o_orderkey") % 5 == 0, "def run").when(F.col("o_orderkey") % 7 == 0, "raise error").otherwise(F.lower("o_orderpriority")))
    group = (F.col("o_custkey") % 40).alias("c")
    return o.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


_FOUND = """found AS (SELECT o_custkey % 40 AS c, o_orderkey AS pos, 'src/f' || (o_orderkey % 6) || '.py' AS file, CAST(o_orderkey AS INTEGER) AS number,
  CASE WHEN o_orderkey % 5 = 0 THEN 'def run' WHEN o_orderkey % 7 = 0 THEN 'raise error' ELSE lower(o_orderpriority) END AS content FROM orders)"""

PLANS = {
    "win1_log_runs": (lambda s, d: t.log_runs(logs(s, d), "user_id", "text").select("user_id", "run", "line", "n"), f"WITH {_LOGS} SELECT user_id, CAST(run AS BIGINT) AS run, line, n FROM runs"),
    "cmp9_log_summary": (
        lambda s, d: t.log_summary(logs(s, d), "user_id", "text"),
        f"""WITH {_LOGS}, x AS (SELECT user_id, CAST(sum(n) AS INTEGER) AS lines, count(*) AS different, CAST(coalesce(sum(n) FILTER (line LIKE '%error%'), 0) AS BIGINT) AS errors, list(CASE WHEN n > 1 THEN line || ' (x' || n || ')' ELSE line END ORDER BY run) AS shown FROM runs GROUP BY 1)
        SELECT user_id, lines, different, errors, CASE WHEN len(shown) > 30 THEN 'last 15 unique lines:' || chr(10) || array_to_string(shown[-15:], chr(10)) ELSE array_to_string(shown, chr(10)) END AS summary FROM x WHERE lines > 10""",
    ),
    "cmp11_grep_groups": (
        lambda s, d: t.grep_groups(searches(s, d), "c", "text"),
        f"WITH {_FOUND} SELECT c, file, count(*) AS n, array_to_string(list(content ORDER BY pos)[1:5], chr(10)) AS content FROM found GROUP BY 1, 2",
    ),
    "cmp3_search_best": (
        lambda s, d: t.search_best(searches(s, d), "c", "text"),
        f"""WITH {_FOUND}, scored AS (SELECT *, least(CASE WHEN content LIKE '%error%' THEN 0.5 ELSE 0.0 END + CASE WHEN contains(lower(content), 'def ') THEN 0.3 ELSE 0.0 END + 0.1, 1.0) AS score FROM found),
        w AS (SELECT *, sum(score) OVER (PARTITION BY c, file) AS total, count(*) OVER (PARTITION BY c) AS n, CASE WHEN pos IN (min(pos) OVER (PARTITION BY c, file), max(pos) OVER (PARTITION BY c, file)) THEN 1 ELSE 0 END AS edge FROM scored),
        p AS (SELECT *, dense_rank() OVER (PARTITION BY c ORDER BY round(total, 6) DESC, file) AS fp, row_number() OVER (PARTITION BY c, file ORDER BY edge DESC, score DESC, pos) AS place FROM w WHERE n > 30)
        SELECT c, file, number, content, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY fp, place) AS rank FROM (SELECT *, count(*) FILTER (fp <= 15) OVER (PARTITION BY c) AS among FROM p) WHERE fp <= 15 AND place <= 5) WHERE rank <= least(greatest(ceil(sqrt(among)), 5), 30)""",
    ),
    "cmp12_find_folders": (
        lambda s, d: t.find_folders(table(s, d, "part").groupBy((F.col("p_partkey") % 5).alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: F.concat(F.lit("./"), F.when(k % 3 == 0, "src/m").when(k % 3 == 1, "node_modules/m").otherwise("m"), (k % 4).cast("string"), F.lit("/k"), k.cast("string"))), "\n").alias("text")), "c", "text"),
        """WITH p AS (SELECT p_partkey % 5 AS c, p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'src/m' ELSE 'm' END || (p_partkey % 4) AS folder FROM part WHERE p_partkey % 3 <> 1)
        SELECT c, folder, count(*) AS n, array_to_string(list('k' || k ORDER BY k)[1:10], ' ') AS files FROM p GROUP BY 1, 2""",
    ),
    "cmp14_html_summary": (
        lambda s, d: table(s, d, "pages").select("page_id", t.html_summary(F.col("html")).alias("summary")),
        """SELECT page_id, 'HTML: "' || CASE WHEN contains(h, '<title>') AND contains(h, '</title>') THEN regexp_extract(h, '(?s)<title>(.*?)</title>', 1) ELSE '(no title)' END || '" (' || octet_length(encode(h)) || ' bytes, ' || len(string_split(h, chr(10))) || ' lines)' AS summary FROM (SELECT page_id, trim(html, chr(32) || chr(9) || chr(13) || chr(10)) AS h FROM pages)""",
    ),
    "cmp13_byte_sizes": (
        lambda s, d: table(s, d, "documents").select("doc_id", t.byte_size(F.octet_length("text").cast("long")).alias("size")),
        "SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f', n / 1048576.0) || 'M' WHEN n >= 1024 THEN printf('%.1f', n / 1024.0) || 'K' ELSE n || 'B' END AS size FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)",
    ),
    "cmp17_compact": (
        lambda s, d: table(s, d, "documents").select("doc_id", t.compact(F.col("text"), 3).alias("text")),
        "SELECT doc_id, CASE WHEN len(l) <= 3 THEN array_to_string(l, chr(10)) ELSE array_to_string(l[1:3], chr(10)) || chr(10) || '... (' || (len(l) - 3) || ' more lines)' END AS text FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)",
    ),
    "ctx8_savings_labels": (
        lambda s, d: table(s, d, "events").select("event_id", t.savings_label(F.floor("value"), F.floor(F.col("value") / 3)).alias("label")),
        "SELECT event_id, CASE WHEN a = 0 OR a = b THEN '0 tok saved' ELSE '[' || (a - b) || ' tok saved (' || CAST(round((a - b) * 100.0 / a) AS BIGINT) || '%)]' END AS label FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value / 3) AS BIGINT) AS b FROM events)",
    ),
}
