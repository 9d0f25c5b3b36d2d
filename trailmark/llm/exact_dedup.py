"""Exact deduplication with a log-structured merge index, in DataFrame functions only.

Every input task is a memtable: flushing writes its (digest, id) entries as a run sorted by digest, whose Parquet files carry
a Bloom filter and value ranges for the digest column. The runs' filters, merged, tell which digests can lie in the index
more than once; the other entries are unique and stay in their runs. Compaction merges FAN runs of a level at a time to one run of
the next level, with one entry per digest: the smallest identifier (or the largest) and the number of rows. A digest with
more than one row is a hit; hits are verified by comparing whole texts with the text of the row that stays, so a
digest collision never merges different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import discard, one_a_row, repeated, row_key, text_digest, without, written

#: Runs of a level that are merged to one run of the next.
FAN = 8
#: Rows of one group that meet one copy of the stayer's text; larger groups get more copies of it.
ROWS_A_COPY = 2000
#: Groups that are spread over several tasks: those of more than a LARGE-th of all rows, so fewer than LARGE (broadcast).
LARGE = 10_000
#: Bits of a filter for each digest, and at least and at most. A filter is broadcast as 64-bit words: 2^26 bits are
#: 1 million rows of 16 bytes. Beyond that more rows pass it than need to, each of them once, and the result is the same.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
_SORTED = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def flush(entries: DataFrame) -> DataFrame:
    """The runs of level 0: each task's entries (digest, id) sorted by digest, with the number of their run."""
    numbered = entries.withColumn("run", F.spark_partition_id())
    return written(numbered.sortWithinPartitions("run", "digest", "id"), "digest-runs", _SORTED)


def bits_for(digests: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * max(1, digests) - 1).bit_length()))


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits))


def bitmap(places: DataFrame) -> DataFrame:
    """word, bits: the places (column `place`) as a table of 64-bit words."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    return places.groupBy((F.col("place") / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))


def marked(rows: DataFrame, filter_: DataFrame, bits: int) -> DataFrame:
    """rows with `may`: whether the filter lets their digest pass."""
    at = rows.withColumn("place", _place(bits)).withColumn("word", (F.col("place") / 64).cast("long"))
    hit = F.call_function("getbit", F.col("bits"), (F.col("place") % 64).cast("int")) == 1
    return at.join(F.broadcast(filter_), "word", "left").withColumn("may", F.coalesce(hit, F.lit(False))).drop("place", "word", "bits")


def suspects(runs: DataFrame, rows: int) -> DataFrame:
    """Entries whose digest the merged filters of the runs show more than once."""
    bits = bits_for(rows)
    again = runs.groupBy(_place(bits).alias("place")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return marked(runs, bitmap(again), bits).filter("may").drop("may")


def compact(runs: DataFrame, keep: str) -> DataFrame:
    """One run with one entry for each digest: digest, keep_id, n. Level by level, FAN runs become one; Spark merges within
    each task before the shuffle, so a digest that fills a third of all runs stays small."""
    pick = F.min("keep_id") if keep == "min" else F.max("keep_id")
    level = runs.select("run", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    last = int(runs.agg(F.max("run")).first()[0] or 0)
    old = None
    while True:
        last //= FAN
        into = F.floor(F.col("run") / FAN).cast("int").alias("run")
        merged = level.groupBy(into, "digest").agg(pick.alias("keep_id"), F.sum("n").alias("n"))
        level = written(merged.sortWithinPartitions("run", "digest"), "digest-level", _SORTED)
        if old is not None:
            discard(old)
        old = level
        if last == 0:
            return level.drop("run")


def look_up(runs: DataFrame, digest: str) -> DataFrame:
    """Identifiers of one digest; the filters of the runs are pushed down to the scan."""
    return runs.filter(F.col("digest") == digest).select("id")


def _salts(rows: DataFrame, hits: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """rows and hits with `salt`: large groups lie in several parts, and their hit in each of them."""
    large = hits.filter(F.col("n") > F.lit(max(ROWS_A_COPY, total // LARGE))).select("digest", F.ceil(F.col("n") / F.lit(ROWS_A_COPY)).cast("int").alias("salts"))
    large = F.broadcast(large)
    salt = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int")
    rows = rows.join(large, "digest", "left").withColumn("salt", salt).drop("salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    return rows, hits.join(large, "digest", "left").select(*hits.columns, every)


def exact_dedup(docs: DataFrame, keep: str = "min", key: str = "doc_id", text: str = "text", digest: Column | None = None) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, digest.

    docs: any columns beside key and text are ignored. A null text counts as empty. Rows repeated in full are all in
    the result and all count in group_size. Null keys group like others and stay only if their group has no other key.
    An empty table gives an empty result. digest: an expression over the column `text`, SHA-256 by default; a
    weak one costs time, not exactness.
    """
    digest = F.sha2(F.col("text"), 256) if digest is None else digest
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", digest)
    runs = flush(rows.select("digest", "id"))
    total = runs.count()
    hits = written(compact(suspects(runs, total), keep).filter("n > 1"), "digest-hits")
    n_hits = hits.count()
    bits = bits_for(n_hits)
    filter_ = written(bitmap(hits.select(_place(bits).alias("place"))), "digest-filter")

    copies, spread = _salts(marked(rows, filter_, bits).filter("may").drop("may"), hits, total)
    copies = copies.join(spread, ["digest", "salt"])
    stayers = copies.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("keep_text"))
    stayers = spread.select("digest", "salt").join(stayers, "digest")
    differs = written(copies.join(stayers, ["digest", "salt"]).filter("text != keep_text").select("digest").distinct(), "digest-collisions")

    entries = marked(runs.select("digest", "id"), filter_, bits)
    own, spread = _salts(entries.filter("may").drop("may"), hits, total)
    out = own.join(spread, ["digest", "salt"], "left").select("digest", "id", "keep_id", "n")
    none = entries.filter("not may").select("digest", "id", F.lit(None).cast(hits.schema["keep_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("n"))
    out = out.unionByName(none)
    if not differs.isEmpty():
        # Different texts share a digest: these digests' rows are grouped by the text itself.
        shared = rows.join(differs, "digest", "left_semi")
        pick = F.min("id") if keep == "min" else F.max("id")
        alike = shared.groupBy("digest", "text").agg(pick.alias("keep_id"), F.count(F.lit(1)).alias("n"))
        shared = shared.join(alike, ["digest", "text"]).select("digest", "id", "keep_id", "n")
        out = out.join(differs, "digest", "left_anti").unionByName(shared)
    return out.select(
        F.col("id").alias(key),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest"),
    )


def kept_rows(docs: DataFrame, keep: str = "min", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of equal texts. Rows are judged by key and text, so rows of one key (or
    without a key) that have different texts stay or go each by itself."""
    found, again = exact_dedup(docs, keep, key, text).filter("not kept"), repeated(docs, key)
    if again.isEmpty():
        return without(docs, written(found.select(F.col(key).alias("gone")), "exact-gone"), key)
    found = written(found.select(row_key(F.col(key), F.col("digest")).alias("gone")), "exact-gone")
    rows = docs.withColumn("_row", row_key(F.col(key), text_digest(text)))
    return one_a_row(without(rows, found, "_row"), again, "_row", key).drop("_row")
