"""Harmonic packing of token sequences.

A text's ids are cut into pieces: whole sequences of the capacity first; of the rest, the largest power of two, once
more the largest power of two of what then remains, and a last piece of any length. A piece of length n belongs to
the class of floor(capacity / n): so many pieces fill one bin of that class. Pieces of a class are numbered by
parts that work independently (counts of the parts before give each its first number), and the number alone
decides bin and place. The few pieces of unfilled bins, fewer than a bin for each class, are packed together.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import written

CAPACITY = 1024
#: Chunks of text whose ids a worker remembers; beyond that it starts anew.
MOST_REMEMBERED = 300_000
PART_ROWS = 4000


class Chunks(dict):
    """The ids, as little-endian bytes, of a space and a chunk of text; of chunks that begin a line, of the chunk.

    Whole texts are encoded by the tokenizer of tokenizer_path. Chunks, which hold no added token, are encoded from the ranks of the
    same vocabulary where ranks_path names them: the ids are the same, and new chunks cost a third."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        #: Strings that the tokenizer takes for one token wherever they stand in a text.
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.encode = self._ranked(ranks_path) if ranks_path else self._whole

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _ranked(path: str):
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def of(self, text: str) -> bytes:
        return np.array(self._whole(text), dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        ids = self[chunk] = np.array(self.encode(chunk if chunk[:1] == "\n" else " " + chunk), dtype="<u4").tobytes()
        return ids


@lru_cache(maxsize=1)
def chunks_of(tokenizer_path: str, ranks_path: str | None) -> Chunks:
    """What a worker remembers of a tokenizer, from one task to the next."""
    return Chunks(tokenizer_path, ranks_path)


def ids_of(text: str, chunks: Chunks, plain) -> bytes:
    """The ids of a text. Where single spaces and line ends are its only white space, the pattern that precedes
    BPE always cuts before them, so chunks between them have ids of their own; other texts, and texts that hold the string of an
    added token, are encoded whole."""
    if not text:
        return b""
    if plain(text) or any(x in text for x in chunks.added):
        return chunks.of(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    return b"".join([chunks.of(first), *map(chunks.__getitem__, rest)])


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out, at = [(s, capacity) for s in range(0, n - capacity + 1, capacity)], n - n % capacity
    for _ in range(2):
        if n > at:
            size = 1 << ((n - at).bit_length() - 1)
            out.append((at, size))
            at += size
    return [*out, (at, n - at)] if n > at else out


def cut_texts(docs: DataFrame, tokenizer_path: str, ranks_path: str | None, end_id: int, capacity: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every text."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import re

        chunks, end = chunks_of(tokenizer_path, ranks_path), np.array([end_id], "<u4").tobytes()
        # White space but for single spaces and line ends within the text; then no chunk is cut off from a space it needs.
        plain = re.compile(r"\s\s|^\s|\s$|[^\S \n]|[\x1c-\x1f\x85᠎]").search
        for batch in batches:
            for keys, texts in ((batch.column(0).slice(i, 256), batch.column(1).slice(i, 256)) for i in range(0, batch.num_rows, 256)):
                row, start, length, crc, total = [], [], [], [], []
                for i, text in enumerate(texts.to_pylist()):
                    ids = ids_of(text or "", chunks, plain) + end
                    n = len(ids) // 4
                    for s, size in cuts(n, capacity):
                        row.append(i)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + size)]))
                        total.append(n)
                whole = pa.int64()
                yield pa.record_batch([keys.take(pa.array(row, whole)), *(pa.array(x, whole) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(run, f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long")


def _first_fit(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        filled, bins, offsets = [], [], []
        for n in frame.length:
            at = next((i for i, used in enumerate(filled) if used + n <= capacity), len(filled))
            if at == len(filled):
                filled.append(0)
            bins.append(at)
            offsets.append(filled[at])
            filled[at] += n
        return frame.assign(bin=bins, offset=offsets).drop(columns=["class", "all"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty and have the end id alone. Rows repeated in full are texts of their own. Keys may be
    null. Sequence numbers are unique, not gapless. An empty table gives an empty result. capacity: a power of two.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    made = written(cut_texts(rows, tokenizer_path, ranks_path, end_id, capacity), "pack-pieces").withColumn("class", F.floor(F.lit(capacity) / F.col("length")))
    parts = max(16, made.count() // PART_ROWS)
    made = made.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    counts = written(made.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    up_to = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("class", "part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("begin"))
    classes = counts.groupBy("class").agg((F.floor(F.sum("n") / F.col("class"))).alias("bins"))  # at most `capacity` rows
    before = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("class", "bins", F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32")
    numbered = made.withColumn("within", F.row_number().over(order) - 1).join(begins, ["class", "part"]).join(F.broadcast(classes), "class")
    numbered = numbered.withColumn("number", F.col("begin") + F.col("within")).withColumn("bin", F.floor(F.col("number") / F.col("class")))
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    numbered = numbered.select(*own, "class", "number", "bin", "bins", "base")
    single = numbered.filter("class = 1").select(*own, (F.col("base") + F.col("bin")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    in_bin = Window.partitionBy("class", "bin").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    shared = numbered.filter("class > 1 and bin < bins").withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    shared = shared.select(*own, (F.col("base") + F.col("bin")).alias("sequence_id"), "offset")
    # Fewer than one bin for each class: at most capacity * ln(capacity) pieces whatever the input.
    last = numbered.filter("bin >= bins").select(*own, "class")
    key_type = last.schema["doc_id"].dataType.simpleString()
    spec = f"doc_id {key_type}, start long, length long, ids_crc32 long, doc_tokens long, bin long, offset long"
    total = classes.agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]
    tail = last.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_first_fit(capacity), spec)
    tail = tail.select(*own, (F.lit(total) + F.col("bin")).alias("sequence_id"), "offset")
    return single.unionByName(shared).unionByName(tail)
