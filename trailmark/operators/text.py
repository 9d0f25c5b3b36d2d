"""Summaries of captured output as plans over exploded lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a log line may begin with, and words that mark an error.
TIMESTAMP = r"^\[?\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}[^\]]*\]?\s*"
ERRORS = "error|fatal|panic|exception"
SKIPPED_FOLDERS = r"(^|/)(node_modules|\.git|target/debug|target/release|__pycache__|\.svelte-kit|\.next|dist|build|\.venv|venv)/"


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line; a last empty line does not count."""
    parts = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    return rows.filter(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("pos", "line"))


def log_runs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, run, line, n: equal lines that follow each other, without timestamps and blank lines (gaps and islands)."""
    bare = F.trim(F.regexp_replace("line", TIMESTAMP, ""))
    found = lines(rows, key, text).withColumn("line", bare).filter("line != ''")
    order = Window.partitionBy(key).orderBy("pos")
    new = F.when(F.lag("line").over(order).eqNullSafe(F.col("line")), 0).otherwise(1)
    runs = found.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("n"))


def log_summary(rows: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    """key, lines, different, errors, summary for outputs of more than `least` lines: runs as "line (xN)", the last 15 of more than 30."""
    sizes = rows.filter(F.col(text).isNotNull()).select(key, F.size(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")).alias("lines")).filter(F.col("lines") > least)
    shown = F.when(F.col("n") > 1, F.concat("line", F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("line"))
    wrong = F.lower("line").rlike(ERRORS)
    by = log_runs(rows.join(sizes.select(key), key, "left_semi"), key, text).groupBy(key).agg(
        F.count(F.lit(1)).alias("different"),
        F.coalesce(F.sum(F.when(wrong, F.col("n"))), F.lit(0)).alias("errors"),
        F.transform(F.array_sort(F.collect_list(F.struct("run", shown.alias("shown")))), lambda x: x["shown"]).alias("all"),
    )
    tail = F.when(F.size("all") > 30, F.concat(F.lit("last 15 unique lines:\n"), F.array_join(F.slice("all", -15, 15), "\n"))).otherwise(F.array_join("all", "\n"))
    return sizes.join(by, key).select(key, "lines", "different", "errors", tail.alias("summary"))


def grep_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, file, number, content of lines like file:number:content (the number may be null)."""
    found = lines(rows, key, text).withColumn("file", F.regexp_extract("line", "^([^:]*):", 1)).filter(F.col("file").rlike("[/.]"))
    rest = F.expr("substring(line, length(file) + 2)")
    found = found.withColumn("rest", rest).withColumn("number", F.regexp_extract("rest", r"^(\d+):", 1))
    content = F.when(F.col("number") != "", F.expr("substring(rest, length(number) + 2)")).otherwise(F.col("rest"))
    return found.select(key, "pos", "file", F.col("number").try_cast("int").alias("number"), F.trim(content).alias("content"))


def grep_groups(rows: DataFrame, key: str, text: str, shown: int = 5, width: int = 80) -> DataFrame:
    """key, file, n, content: the first matches of each file, cut to a width, in one row for each file."""
    m = grep_lines(rows, key, text)
    cut = F.when(F.length("content") > width, F.concat(F.left("content", F.lit(width - 1)), F.lit("…"))).otherwise(F.col("content"))
    place = F.row_number().over(Window.partitionBy(key, "file").orderBy("pos"))
    m = m.withColumns({"content": cut, "place": place})
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("pos", "content")))), lambda x: x["content"]), "\n")
    return m.groupBy(key, "file").agg(F.count(F.lit(1)).alias("n"), kept.alias("content"))


#: Lines that matter in search results, most important first, and what definitions hold.
PRIORITIES = (r"(?i)\berror\b", r"(?i)\bfail(ed|ure|ing)?\b", r"(?i)\bwarn(ing)?\b", r"(?i)\bpanic\b", r"(?i)\bexception\b", r"(?i)\btimeout\b")
DEFINITIONS = ("fn ", "def ", "class ", "struct ", "impl ", "function ")


def search_best(rows: DataFrame, key: str, text: str, most_files: int = 15, a_file: int = 5, least: int = 30) -> DataFrame:
    """key, file, number, content, score: the best of many search results.

    A line scores by its priority, as a definition and for not being blank. Files come by the sum of their scores; of n
    matches in the first 15 files max(5, min(30, ceil(sqrt(n)))) are kept, at most five a file, where the first and last match of a file go before the rest."""
    m = grep_lines(rows, key, text).filter("number is not null")
    score = F.lit(0.0)
    for i, pattern in reversed(list(enumerate(PRIORITIES))):
        score = F.when(F.col("content").rlike(pattern), F.lit(0.5 - 0.05 * i)).otherwise(score)
    defines = reduce(lambda a, b: a | b, (F.lower("content").contains(x) for x in DEFINITIONS))
    score = F.least(score + F.when(defines, 0.3).otherwise(0.0) + F.when(F.col("content").rlike(r"\S"), 0.1).otherwise(0.0), F.lit(1.0))
    own, whole = Window.partitionBy(key, "file"), Window.partitionBy(key)
    m = m.withColumn("score", F.round(score, 4))
    m = m.withColumns({"total": F.sum("score").over(own), "n": F.count(F.lit(1)).over(whole), "edge": F.when((F.col("pos") == F.min("pos").over(own)) | (F.col("pos") == F.max("pos").over(own)), 1).otherwise(0)}).filter(F.col("n") > least)
    m = m.withColumns({"file_place": F.dense_rank().over(whole.orderBy(F.desc(F.round("total", 6)), "file")), "place": F.row_number().over(own.orderBy(F.desc("edge"), F.desc("score"), "pos"))})
    m = m.withColumn("among", F.count_if(F.col("file_place") <= most_files).over(whole)).filter((F.col("file_place") <= most_files) & (F.col("place") <= a_file))
    budget = F.least(F.greatest(F.ceil(F.sqrt("among")), F.lit(5)), F.lit(30))
    kept = m.withColumn("rank", F.row_number().over(whole.orderBy("file_place", "place"))).filter(F.col("rank") <= budget)
    return kept.select(key, "file", "number", "content", "score")


def find_folders(rows: DataFrame, key: str, text: str, shown: int = 10) -> DataFrame:
    """key, folder, n, files: paths grouped by folder, the first ten of each."""
    path = F.regexp_replace(F.trim("line"), r"^\./", "")
    p = lines(rows, key, text).withColumn("path", path).filter((F.col("path") != "") & ~F.col("path").rlike(SKIPPED_FOLDERS))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("."))
    p = p.withColumns({"folder": folder, "file": F.element_at(F.split("path", "/"), -1)})
    p = p.withColumn("place", F.row_number().over(Window.partitionBy(key, "folder").orderBy("pos")))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("pos", "file")))), lambda x: x["file"]), " ")
    return p.groupBy(key, "folder").agg(F.count(F.lit(1)).alias("n"), kept.alias("files"))


def html_summary(text: Column) -> Column:
    """HTML: "title" (bytes, lines)."""
    t = F.trim(text, F.lit(" \t\r\n"))
    title = F.regexp_extract(t, "(?s)<title>(.*?)</title>", 1)
    title = F.when(t.rlike("(?s)<title>.*?</title>"), title).otherwise("(no title)")
    n = F.size(F.split(F.regexp_replace(t, "\n$", ""), "\n"))
    return F.concat(F.lit('HTML: "'), title, F.lit('" ('), F.octet_length(t).cast("string"), F.lit(" bytes, "), n.cast("string"), F.lit(" lines)"))


def byte_size(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.concat(F.format_string("%.1f", F.bround(n / float(1 << 20), 1)), F.lit("M"))).when(n >= 1024, F.concat(F.format_string("%.1f", F.bround(n / 1024.0, 1)), F.lit("K"))).otherwise(F.concat(n.cast("string"), F.lit("B")))


def compact(text: Column, n: int) -> Column:
    """All lines that are not blank, or the first n and how many more there are."""
    kept = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    more = F.concat(F.array_join(F.slice(kept, 1, n), "\n"), F.lit("\n... ("), (F.size(kept) - n).cast("string"), F.lit(" more lines)"))
    return F.when(F.size(kept) <= n, F.array_join(kept, "\n")).otherwise(more)


def savings_label(original: Column, compressed: Column) -> Column:
    saved = F.greatest(original - compressed, F.lit(0))
    pct = F.round(F.try_divide(saved * 100.0, original)).cast("long")
    return F.when((original == 0) | (saved == 0), F.lit("0 tok saved")).otherwise(F.concat(F.lit("["), saved.cast("string"), F.lit(" tok saved ("), pct.cast("string"), F.lit("%)]")))
