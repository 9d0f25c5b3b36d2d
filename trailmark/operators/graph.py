"""Code graphs: paths, import resolution by equi-joins, fan-in and two-cycles, file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.filters import generated

#: Endings that are tried for an import, best first.
RELATIVE_ENDS = ("", ".js", ".ts", ".tsx", ".jsx", ".py", ".rs", "/index.js", "/index.ts", "/mod.rs")
SUFFIX_ENDS = ("", ".js", ".ts", ".py", ".rs", ".go", ".java", ".rb", ".cs")


def normal(path: Column) -> Column:
    """.. takes back the segment before it; . and empty segments go, and with them a leading slash."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")

    def step(a: Column, p: Column) -> Column:
        return F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))

    return F.array_join(F.aggregate(parts, start, step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges (from_file, source) with to_file among files (path), '' where none fits.

    Relative sources are candidates with each ending, matched on the normal path. Other sources match the end of a path:
    every file offers all ends of its path, so that too is an equi-join. Earlier endings win, then smaller paths."""
    edges = edges.dropDuplicates(["from_file", "source"]).withColumn("folder", folder(F.col("from_file")))
    # What a relative source means depends on the folder alone, what another one means on the source alone: each is tried once.
    relative = edges.filter(F.col("source").startswith(".")).select("folder", "source").distinct()
    ends = F.posexplode(F.array(*[F.lit(e) for e in RELATIVE_ENDS]))
    bare = normal(F.concat("folder", F.lit("/"), F.regexp_replace("source", r"^(\./)+", "")))
    tries = relative.withColumn("bare", bare).select("folder", "source", "bare", ends.alias("rank", "end")).withColumn("path", F.concat("bare", "end"))
    hits = tries.join(files.select("path", normal(F.col("path")).alias("normal")).withColumnRenamed("path", "to_file"), F.col("path") == F.col("normal"))
    first = hits.groupBy("folder", "source").agg(F.min_by("to_file", F.struct("rank", "to_file")).alias("first"))
    known = edges.join(first, ["folder", "source"], "left")
    rest = known.filter("first is null").select("source").distinct()
    ends = F.posexplode(F.array(*[F.lit(e) for e in SUFFIX_ENDS]))
    tries = rest.withColumn("bare", F.replace(F.col("source"), F.lit("::"), F.lit("/"))).filter("bare != ''").select("source", "bare", ends.alias("rank", "end")).withColumn("tail", F.concat("bare", "end"))
    # A source may begin within a segment, so ends of a path are offered wherever they begin, but only of lengths that sources have.
    lengths = tries.agg(F.collect_set(F.length("tail")).alias("lengths"))  # one row
    offered = F.explode(F.filter("lengths", lambda n: n <= F.length("path")))
    tails = files.select("path").join(F.broadcast(lengths), how="cross").select("path", offered.alias("n")).select(F.col("path").alias("to_file"), F.right("path", F.col("n")).alias("tail"))
    second = tries.join(tails, "tail").groupBy("source").agg(F.min_by("to_file", F.struct("rank", "to_file")).alias("second"))
    return known.join(second, "source", "left").select("from_file", "source", F.coalesce("first", "second", F.lit("")).alias("to_file"))


def fan_in(edges: DataFrame, least: int = 3) -> DataFrame:
    """to_file, importers, hot: how many different files import a file."""
    known = edges.filter("to_file != '' and to_file != from_file")
    return known.groupBy("to_file").agg(F.count_distinct("from_file").alias("importers")).withColumn("hot", F.col("importers") >= least)


def mutual(edges: DataFrame) -> DataFrame:
    """a < b: files that import each other."""
    e = edges.filter("to_file != '' and to_file != from_file").select("from_file", "to_file").distinct()
    back = e.select(F.col("to_file").alias("from_file"), F.col("from_file").alias("to_file"))
    return e.join(back, ["from_file", "to_file"], "left_semi").select(F.least("from_file", "to_file").alias("a"), F.greatest("from_file", "to_file").alias("b")).distinct()


def segments(path: Column) -> tuple[Column, Column]:
    """The first and second folder of a path; (root) and (files) where it has none."""
    p = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(p) > 1, F.element_at(p, 1)).otherwise(F.lit("(root)")), F.when(F.size(p) > 2, F.element_at(p, 2)).otherwise(F.lit("(files)"))


def clearings(files: DataFrame, heroes: int = 3) -> DataFrame:
    """The heaviest files of each pair of first and second folder, with their place."""
    top, sub = segments(F.col("path"))
    rows = files.withColumns({"module": top, "sub": sub})
    place = F.row_number().over(Window.partitionBy("module", "sub").orderBy(F.desc("weight"), "path"))
    return rows.withColumn("place", place).filter(F.col("place") <= heroes).select("module", "sub", "path", "weight", "place")


def folders(files: DataFrame) -> DataFrame:
    """folder, lines, files, heat: totals of each folder; heat by the mean size of its files."""
    by = files.groupBy(folder(F.col("path")).alias("folder")).agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("files"))
    mean = F.col("lines") / F.col("files")
    return by.withColumn("heat", F.when(mean <= 200, "cool").when(mean <= 500, "warm").otherwise("hot"))


def big_files(files: DataFrame, n: int = 5, least: int = 2000) -> DataFrame:
    """The longest files that no tool generates, each path once, with how many more there are."""
    kept = files.filter((F.col("lines") > least) & ~generated(F.col("path"))).groupBy("path").agg(F.max("lines").alias("lines"))
    more = kept.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return kept.orderBy(F.desc("lines"), "path").limit(n).join(F.broadcast(more), how="cross")


def numbered_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 0), content: the lines of a text."""
    return rows.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "content"))


def line_slice(rows: DataFrame, key: str, text: str, offset: int, limit: int) -> DataFrame:
    return numbered_lines(rows, key, text).filter((F.col("line") >= offset) & (F.col("line") < offset + limit))


def file_estimates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, lines, tokens: as the file views count them."""
    from trailmark.operators.dlp import estimated_tokens

    return rows.select(key, F.size(F.split(F.rtrim(F.coalesce(text, F.lit("")), F.lit("\n")), "\n")).alias("lines"), estimated_tokens(F.coalesce(text, F.lit(""))).alias("tokens"))
