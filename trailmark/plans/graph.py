"""Code-graph queries: parts play files, supplies of an order play imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import graph as g
from trailmark.sources.adapters import table


def files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("src/m"), (F.col("p_partkey") % 7).cast("string"), F.lit("/k"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".py").otherwise(".js")).alias("path"), (F.col("p_partkey") * 13).alias("lines"))


def imports(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") * 3).alias("b"))
    name = F.concat(F.lit("m"), (F.col("b") % 7).cast("string"), F.lit("/k"), F.col("b").cast("string"))
    source = F.when(F.col("b") % 3 == 0, F.concat(F.lit("../"), name)).when(F.col("b") % 3 == 1, F.concat(F.lit("src::"), F.replace(name, F.lit("/"), F.lit("::")))).otherwise("os")
    path = F.concat(F.lit("src/m"), (F.col("a") % 7).cast("string"), F.lit("/k"), F.col("a").cast("string"), F.when(F.col("a") % 2 == 0, ".py").otherwise(".js"))
    return i.select(path.alias("from_file"), source.alias("source"))


def edges(spark, sf_dir):
    return g.resolve(imports(spark, sf_dir), files(spark, sf_dir))


VIEWS = """files AS (SELECT 'src/m' || (p_partkey % 7) || '/k' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.js' END AS path, p_partkey * 13 AS lines FROM part),
imports AS (SELECT DISTINCT 'src/m' || (a % 7) || '/k' || a || CASE WHEN a % 2 = 0 THEN '.py' ELSE '.js' END AS from_file,
  CASE b % 3 WHEN 0 THEN '../m' || (b % 7) || '/k' || b WHEN 1 THEN 'src::m' || (b % 7) || '::k' || b ELSE 'os' END AS source
  FROM (SELECT l_partkey AS a, l_suppkey * 3 AS b FROM lineitem)),
edges AS (SELECT from_file, source, coalesce((SELECT min(path) FROM files f WHERE regexp_replace(f.path, '\\.(py|js)$', '') = CASE WHEN source LIKE '../%' THEN 'src/' || substr(source, 4) ELSE replace(source, '::', '/') END), '') AS to_file FROM imports)"""

PLANS = {
    "jon6_import_resolution": (edges, f"WITH {VIEWS} SELECT * FROM edges"),
    "agg31_fan_in": (
        lambda s, d: g.fan_in(edges(s, d)),
        f"WITH {VIEWS} SELECT to_file, count(DISTINCT from_file) AS importers, count(DISTINCT from_file) >= 3 AS hot FROM edges WHERE to_file <> '' AND to_file <> from_file GROUP BY 1",
    ),
    "jon8_mutual_imports": (
        lambda s, d: g.mutual(edges(s, d)),
        f"WITH {VIEWS} SELECT DISTINCT least(x.from_file, x.to_file) AS a, greatest(x.from_file, x.to_file) AS b FROM edges x JOIN edges y ON x.from_file = y.to_file AND x.to_file = y.from_file WHERE x.to_file <> '' AND x.from_file <> x.to_file",
    ),
    "agg27_clearings": (
        lambda s, d: g.clearings(files(s, d).withColumnRenamed("lines", "weight")),
        f"WITH {VIEWS} SELECT 'src' AS module, sub, path, weight, place FROM (SELECT split_part(path, '/', 2) AS sub, path, lines AS weight, CAST(row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY lines DESC, path) AS INTEGER) AS place FROM files) WHERE place <= 3",
    ),
    "agg30_folders": (
        lambda s, d: g.folders(files(s, d)),
        f"WITH {VIEWS} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS files, CASE WHEN sum(lines) / count(*) <= 200 THEN 'cool' WHEN sum(lines) / count(*) <= 500 THEN 'warm' ELSE 'hot' END AS heat FROM files GROUP BY 1",
    ),
    "agg32_big_files": (
        lambda s, d: g.big_files(files(s, d)),
        f"WITH {VIEWS} SELECT path, lines, (SELECT greatest(count(*) - 5, 0) FROM files WHERE lines > 2000) AS more FROM files WHERE lines > 2000 ORDER BY lines DESC, path LIMIT 5",
    ),
    "sym5_normal_paths": (
        lambda s, d: table(s, d, "pages").select("page_id", g.normal(F.concat(F.lit("/a/./b/../"), F.regexp_extract("url", "://([^?#]*)", 1))).alias("path")),
        "SELECT page_id, 'a/' || rtrim(regexp_extract(url, '://([^?#]*)', 1), '/') AS path FROM pages",
    ),
    "sym6_file_estimates": (
        lambda s, d: g.file_estimates(table(s, d, "documents"), "doc_id", "text"),
        "SELECT doc_id, CAST(len(string_split(rtrim(text, chr(10)), chr(10))) AS INTEGER) AS lines, CAST(floor(len(regexp_extract_all(text, '[^\\s\\x{85}\\x{A0}]+')) * 1.5) AS BIGINT) AS tokens FROM documents",
    ),
    "sym7_segments": (
        lambda s, d: files(s, d).select("path", g.segments(F.col("path"))[0].alias("module"), g.segments(F.col("path"))[1].alias("sub")),
        f"WITH {VIEWS} SELECT path, 'src' AS module, split_part(path, '/', 2) AS sub FROM files",
    ),
    "src6_ctx5_line_slice": (
        lambda s, d: g.line_slice(table(s, d, "documents"), "doc_id", "text", 1, 3),
        "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, lines[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(2, 5)) AS i FROM documents) WHERE i <= len(lines)",
    ),
}
