"""Helpers that the corpus operators share: the shared folder, written tables, words, hashes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; bytes.split() cuts UTF-8 text in just this way.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them reach")
        found = f"file://{tempfile.mkdtemp(prefix='trailmark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_forget, spark, found)
    return found.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before this process does
        pass


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once what was made of them is written itself; other tables are left alone."""
    for table in tables:
        if hasattr(table, "written_at"):
            _forget(table.sparkSession, table.written_at)


#: Keys that a join broadcasts at most; more of them are shuffled.
BROADCAST_KEYS = 200_000


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs less the rows whose key is in gone (one column, `gone`), null keys too."""
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return docs.join(gone, F.col(key).eqNullSafe(F.col("gone")), "left_anti")


def repeated(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys (one column, `gone`) that do not tell rows apart: those of several rows, and null."""
    return written(docs.groupBy(F.col(key).alias("gone")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or gone is null").select("gone"), "keys-again")


def row_key(key: Column, digest: Column) -> Column:
    """What tells rows apart where keys do not: key and digest of the text. Null keys come last."""
    return F.struct(key.isNull().alias("missing"), key.alias("key"), digest.alias("digest"))


def text_digest(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def one_a_row(docs: DataFrame, again: DataFrame, row: str, key: str = "doc_id") -> DataFrame:
    """docs with one row for each value of the column `row`; only rows whose key is in again are moved."""
    few = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    few = docs.join(few, F.col(key).eqNullSafe(F.col("gone"))).drop("gone").dropDuplicates([row])
    return without(docs, again, key).unionByName(few)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written: its cleaner acts on collected objects."""
    gc.collect()
    spark._jvm.System.gc()


def hash_sample(df: DataFrame, size: int, *by: str) -> DataFrame:
    """About `size` rows (all, if there are no more): those whose hash of `by` lies in the first part of its range. Every
    task keeps its own share, so that no task and no driver sees more than the sample."""
    n = df.count()
    if n <= size:
        return df
    return df.filter(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < F.lit(int((1 << 40) * size / n)))


def n_words(text: Column) -> Column:
    """The number of words of a text; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WORD_GAP))).cast("long")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
