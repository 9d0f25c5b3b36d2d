"""Substring deduplication on a De Bruijn graph of words.

Every run of K words (a window) is an edge of the graph. Only edges that occur again matter, and most do not, so the
graph is built sparsely: a window is grouped by its anchor, the least hash among its shorter runs, which equal windows
share; windows whose anchor occurs once are unique and never shuffled. Repeated edges are joined to their first
occurrence (their source coordinates). Edges that follow each other both in the text and at the source form a
nonbranching path and are compacted into one span. Each span's words are fetched at its source coordinates
and compared before they are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import discard, mix64, released, written

K, ANCHOR = 20, 8
#: Copies whose keys are broadcast at most; beyond that the join shuffles.
BROADCAST_KEYS = 200_000
#: Spans that one copy of a source's text answers at most.
ANSWERS = 500
MOST_REMEMBERED = 300_000
_BASE1, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged, in UTF-8; none for null."""
    return (text or "").encode("utf-8", "replace").split()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def rolling(x: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of every run of `size` values, by doubling: runs of 2, 4, 8... and their joins."""
    if len(x) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        done, length, part, width, power = None, 0, x, 1, base
        while True:
            if size & width:
                if done is None:
                    done, length, shift = part, width, power
                else:
                    n = len(x) - length - width + 1
                    done = done[:n] * power + part[length : length + n]
                    length += width
            if width * 2 > size:
                return mix64(done)
            part = part[:-width] * power + part[width:]
            power, width = power * power, width * 2


def flat(texts, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and where each text begins (and the last ends)."""
    ends, out = [0], []
    for text in texts:
        found = words(text)
        out.append(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
        ends.append(ends[-1] + len(found))
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.array(ends)


def least(x: np.ndarray, size: int) -> np.ndarray:
    """The least value of every run of `size` values, by doubling."""
    part, width = x, 1
    while width * 2 <= size:
        part, width = np.minimum(part[:-width], part[width:]), width * 2
    rest = size - width
    return np.minimum(part[: len(part) - rest], part[rest:]) if rest else part


def anchor_runs(docs: DataFrame) -> DataFrame:
    """anchor, doc_id, first, last, times: runs of window starts that have one anchor, and how often it lies there."""

    def run(batches):
        hashes = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                values, ends = flat(batch.column(1).to_pylist(), hashes)
                if len(values) < K:
                    continue
                short = rolling(values, ANCHOR, _BASE1)
                anchors = least(short, K - ANCHOR + 1)
                text = np.searchsorted(ends, np.arange(len(anchors)), side="right") - 1
                inside = np.arange(len(anchors)) + K <= ends[text + 1]
                begins = np.ones(len(anchors), bool)
                begins[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
                begins &= inside
                first = np.flatnonzero(begins)
                if not len(first):
                    continue
                # A run ends before the next one begins, or with the last window of its text.
                last = np.minimum(np.append(first[1:], len(anchors)) - 1, ends[text[first] + 1] - K)
                own = ends[text[first]]
                # A text that repeats itself closely has an anchor more than once in one run.
                size = last - first + K - ANCHOR + 1
                starts = np.cumsum(size) - size
                same = short[np.arange(size.sum()) + np.repeat(first - starts, size)] == np.repeat(anchors[first], size)
                times = np.add.reduceat(same.astype(np.int32), starts)
                yield pa.record_batch([pa.array(anchors[first].view(np.int64)), batch.column(0).take(pa.array(text[first])), pa.array((first - own).astype(np.int32)), pa.array((last - own).astype(np.int32)), pa.array(times.astype(np.int32))], ["anchor", "doc_id", "first", "last", "times"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"anchor long, doc_id {key}, first int, last int, times int")


def edges(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, pos of the windows in each text's `runs`; h1 and h2 are 96 bits of independent hashes."""

    def run(batches):
        hashes = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                values, ends = flat(batch.column(1).to_pylist(), hashes)
                h1, h2 = rolling(values, K, _BASE1), rolling(mix64(values + _BASE2), K, _BASE2)
                rows, places = [], []
                for i, runs in enumerate(batch.column(2).to_pylist()):
                    pos = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs]))
                    places.append(pos)
                    rows.append(np.full(len(pos), i))
                rows, places = np.concatenate(rows), np.concatenate(places)
                at_all = ends[rows] + places
                yield pa.record_batch([pa.array(h1[at_all].view(np.int64)), pa.array((h2[at_all] >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(pa.array(rows)), pa.array(places.astype(np.int32))], ["h1", "h2", "doc_id", "pos"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "runs").mapInArrow(run, f"h1 long, h2 int, doc_id {key}, pos int")


def copies_of(docs: DataFrame) -> DataFrame:
    """doc_id of texts that are equal to the text of a smaller doc_id."""
    digests = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    groups = digests.groupBy("digest").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return digests.join(groups, "digest").filter(F.col("doc_id") > F.col("keep")).select("doc_id")


def spans(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id, start, stop, source_id, source_start: windows start..stop-1 of a text that also start earlier, at the
    source, compacted into paths."""
    small = copies.count() <= BROADCAST_KEYS
    firsts = docs.join(F.broadcast(copies) if small else copies, "doc_id", "left_anti")
    anchors = written(anchor_runs(firsts), "substring-anchors")
    again = anchors.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    runs = written(anchors.join(again, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "substring-runs")
    discard(anchors)
    released(docs.sparkSession)
    found = written(edges(docs.join(runs, "doc_id")), "substring-edges")
    discard(runs)
    released(docs.sparkSession)
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("source"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = found.join(first, ["h1", "h2"]).filter((F.col("doc_id") > F.col("source.doc_id")) | (F.col("pos") > F.col("source.pos")))
    later = later.select("doc_id", "pos", F.col("source.doc_id").alias("source_id"), F.col("source.pos").alias("source_pos"))
    later = written(later, "substring-later")
    discard(found)
    released(docs.sparkSession)
    shift = F.col("pos") - F.col("source_pos")
    order = Window.partitionBy("doc_id", "source_id", "shift").orderBy("pos")
    path = later.withColumn("shift", shift).withColumn("path", F.col("pos") - F.row_number().over(order))
    paths = path.groupBy("doc_id", "source_id", "shift", "path").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.min("source_pos").alias("source_start")).drop("shift", "path")
    out = written(paths, "substring-spans")
    discard(later)
    released(docs.sparkSession)
    return out


def quoted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found with `quote`: the words at the source coordinates. A source that many spans ask is asked in groups."""
    asked = found.groupBy("source_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(ANSWERS)).cast("int").alias("groups"))
    asks = found.join(asked, "source_id").withColumn("group", F.pmod(F.xxhash64("doc_id", "start"), F.col("groups")).cast("int"))
    asks = asks.groupBy("source_id", "group").agg(F.collect_list(F.struct("doc_id", "start", "stop", "source_start")).alias("asks"))
    asks = docs.select(F.col("doc_id").alias("source_id"), "text").join(asks, "source_id")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch, rows = whole.slice(at, 64), []
                for text, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = words(text)
                    rows += [a | {"quote": b" ".join(found[a["source_start"] : a["source_start"] + a["stop"] - a["start"] + K - 1])} for a in asks]
                for a in rows:
                    del a["source_start"]
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", kinds[key]), ("start", pa.int32()), ("stop", pa.int32()), ("quote", pa.binary())])
    return asks.select("text", "asks").mapInArrow(run, f"doc_id {key}, start int, stop int, quote binary")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row for each row of docs.

    A word goes if a window of K words that covers it also starts earlier: in a text of smaller key, or before in its
    own. Windows are judged on the input. Null texts have no words. Rows repeated in full are one text; rows with a
    null key are texts without windows to find, and keep their words. Texts of fewer than K words keep all. An empty
    table gives an empty result. Kept words are joined by one space.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    keyed = rows.filter("doc_id is not null")
    copies = written(copies_of(keyed).distinct(), "substring-copies")
    found = spans(keyed, copies)
    quotes = written(quoted(keyed, found), "substring-quotes")
    released(docs.sparkSession)
    marks = quotes.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "quote")).alias("spans"))
    marks = marks.withColumn("whole", F.lit(False)).unionByName(copies.select("doc_id", F.array().cast(marks.schema["spans"].dataType).alias("spans"), F.lit(True).alias("whole")))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch, n, gone, sha, kept_texts = whole.slice(at, 128), [], [], [], []
                for text, spans, all_of_it in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    found = words(text)
                    kept = np.ones(len(found), bool)
                    if all_of_it and len(found) >= K:
                        kept[:] = False
                    for s in spans or ():
                        stop = s["stop"] + K - 1
                        if b" ".join(found[s["start"] : stop]) == s["quote"]:
                            kept[s["start"] : stop] = False
                    left = b" ".join(found if kept.all() else [found[i] for i in np.flatnonzero(kept)])
                    n.append(len(found))
                    gone.append(int(len(found) - kept.sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept_texts.append(left.decode("utf-8", "replace"))
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(marks, "doc_id", "left").select("doc_id", "text", "spans", "whole").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
