"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary texts and one on windows of toxic texts. A text is cut into
overlapping windows of WINDOW words; a window's distance is the length that it compresses to with the ordinary dictionary
less the length with the toxic one (which stands beside the ordinary one, so that ordinary words cost the same in both). The
counts of windows that reach each threshold, over the whole text, give a score through a calibrated logistic curve.

zstandard's trainer keeps what is frequent, and toxic texts are made of ordinary words for the greater part. So the toxic
dictionary learns from the words, one sample for each window around them, whose segments (starts of words, and words) are far more frequent in toxic than
in ordinary texts. Frequencies count different windows, not occurrences: a text with a thousand copies counts once.
Every window begins with the same bytes, which both dictionaries hold: zstandard stores very short blocks that
do not shrink as they are, and their lengths would then say nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import discard, hash_sample, remainder, written

#: Bounds of the training sample: ordinary and toxic texts (whole ones, drawn by hash), and windows that each dictionary learns from.
SAMPLE_TEXTS, SAMPLE_WINDOWS = (3000, 1500), 40_000
#: Words of a window, and from one window to the next.
WINDOW, STEP = 5, 4
#: What every window begins with, and what ends a word in a segment.
LEAD, CLOSE = bytes(range(1, 33)), b"\x00"
#: Bytes of a segment, of the toxic and of the ordinary dictionary, and of the parts that the trainer picks.
SEGMENT, TOXIC_BYTES, ORDINARY_BYTES, PARTS = (4, 14), 4096, 16_384, (12, 32)
#: A segment marks toxic text if the logarithm of its rate there over its rate in ordinary text exceeds this, with both rates
#: moved by two standard errors against it.
LIFT = 1.5
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
_GAPS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words in lower case: runs of ASCII letters and digits and of all other characters of UTF-8."""
    return [w for w in _GAPS.split((text or "").lower().encode("utf-8", "replace")) if w]


def windows(found: list[bytes]) -> list[bytes]:
    """The windows of a text; one of fewer words for a short text, none for a text without words."""
    if not found:
        return []
    return [LEAD + b" ".join(found[i : i + WINDOW]) + b" " for i in range(0, max(1, len(found) - WINDOW + STEP), STEP)]


class Distance:
    """Compression distances of windows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._compressor(ordinary + toxic + LEAD), self._compressor(ordinary + LEAD)

    @staticmethod
    def _compressor(content: bytes):
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, search_log=4, hash_log=12, chain_log=13, window_log=15, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)

    def __call__(self, text: str | None) -> np.ndarray:
        toxic, ordinary = self.toxic.compress, self.ordinary.compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(words(text))], np.int32)


def features(distance: Distance, text: str | None) -> np.ndarray:
    """Counts of windows at each threshold, on a log scale, as such and for 100 windows; and the number of windows."""
    values = distance(text)
    hits = np.array([(values >= t).sum() for t in THRESHOLDS], float)
    return np.concatenate([np.log1p(hits), np.log1p(100 * hits / max(1, len(values))), [np.log1p(len(values)), 1.0]])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    weights = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def dictionary(samples: list[bytes], size: int, part: int) -> bytes:
    """A dictionary that zstandard trains on the samples; their end where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, [s.ljust(8) for s in samples], k=part, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic of a bounded sample of labelled texts by a hash of the key; and all labelled texts of each class."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    keys = written(rows.select("doc_id").join(marks, "doc_id"), "toxic-keys")
    ordinary, toxic = (hash_sample(keys.filter(F.col("toxic") == k), SAMPLE_TEXTS[k], "doc_id") for k in (0, 1))
    counts = {int(r[0]): int(r[1]) for r in keys.groupBy("toxic").count().collect()}  # two rows
    few = F.broadcast(ordinary.unionByName(toxic).distinct())  # about as many keys as SAMPLE_TEXTS
    found = written(rows.join(few, "doc_id"), "toxic-sample")
    discard(keys)
    return found, counts


def seen_windows(known: DataFrame) -> DataFrame:
    """toxic, window, word: each different window of a word between its neighbours, once for each class."""

    def run(batches):
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = [b"", *words(text), b""]
                own = {b" ".join(w[i - 1 : i + 2]): w[i] for i in range(1, len(w) - 1)}
                yield pa.record_batch([pa.array(np.full(len(own), toxic, np.int32)), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.binary())], ["toxic", "window", "word"])

    found = known.select("toxic", "text").mapInArrow(run, "toxic int, window binary, word binary")
    return found.groupBy("toxic", "window").agg(F.min("word").alias("word"))


def _segments(word: Column) -> Column:
    """The segments of a word: its starts of SEGMENT bytes, its closing byte included."""
    marked = F.concat(word, F.lit(bytearray(CLOSE)))
    sizes = F.filter(F.sequence(F.lit(SEGMENT[0]), F.lit(SEGMENT[1])), lambda n: n <= F.length(marked))
    return F.transform(sizes, lambda n: F.substring(marked, F.lit(1), n))


def toxic_segments(seen: DataFrame, toxic_texts: int) -> list[bytes]:
    """Segments that mark toxic text. At least 5 windows and one for every 100 toxic texts of the sample hold each of them."""
    sizes = {int(r[0]): int(r[1]) for r in seen.groupBy("toxic").count().collect()}  # two rows
    per_word = seen.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    found = per_word.select("a", "b", F.explode(_segments(F.col("word"))).alias("segment")).groupBy("segment").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    low = F.greatest(F.col("a") - 2 * F.sqrt("a"), F.lit(0.05)) / max(1, sizes.get(1, 0))
    high = (F.col("b") + 0.5 + 2 * F.sqrt(F.col("b") + 1)) / max(1, sizes.get(0, 0))
    chosen = found.filter((F.col("a") >= 5 + 0.01 * toxic_texts) & (F.log(low) - F.log(high) > LIFT)).select("segment")
    return sorted(bytes(r[0]) for r in chosen.collect())  # fewer than a fifth of the sample's windows, times the sizes


def train(known: DataFrame, counts: dict[int, int]) -> dict | None:
    """Dictionaries and weights; None where one of the classes is missing. known: doc_id, text, toxic (a bounded sample); counts: all
    labelled texts of each class, whose odds the scores keep. Texts stay in tasks: the driver sees windows and counts."""
    have = {int(r[0]): int(r[1]) for r in known.groupBy("toxic").count().collect()}  # two rows
    if set(have) != {0, 1}:
        return None
    seen = written(seen_windows(known), "toxic-windows")
    segments = toxic_segments(seen, have[1])
    marked = F.exists(_segments(F.col("word")), lambda s: s.isin([bytearray(s) for s in segments])) if segments else F.lit(False)

    def some(rows: DataFrame, what: str) -> list[bytes]:
        rows = hash_sample(rows, SAMPLE_WINDOWS, "window").select(what, F.xxhash64("window").alias("h"))
        return [b" " + bytes(r[0]) + b" " for r in sorted(rows.collect(), key=lambda r: (r[1], bytes(r[0])))]  # about SAMPLE_WINDOWS

    model = {
        "toxic": dictionary(some(seen.filter((F.col("toxic") == 1) & marked), "word"), TOXIC_BYTES, PARTS[0]),
        "ordinary": dictionary(some(seen.filter("toxic = 0"), "window"), ORDINARY_BYTES, PARTS[1]),
    }
    discard(seen)

    def run(batches):
        distance = Distance(model["toxic"], model["ordinary"])
        for batch in batches:
            rows = [features(distance, t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(list(map(list, rows)), pa.list_(pa.float64()))], ["toxic", "x"])

    found = known.select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").collect()  # a row for each text of the sample
    found.sort(key=lambda r: (r.x, r.toxic))
    y = np.array([r.toxic for r in found], float)
    model["weights"] = _logistic(np.array([r.x for r in found]), y)
    model["weights"][-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def scorer(docs: DataFrame, labels: DataFrame):
    """A function of a text column that gives its scores."""
    known, counts = sample(docs, labels)
    model = train(known, counts)
    discard(known)
    prior = float(max(counts, default=0))

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = Distance(model["toxic"], model["ordinary"]) if model else None
        for texts in series:
            if model is None:
                yield pd.Series(np.full(len(texts), prior))
            else:
                z = np.array([features(distance, t) for t in texts] or np.zeros((0, len(model["weights"])))) @ model["weights"]
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return F.pandas_udf(run, "double")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, less the texts that score as toxic."""
    return docs.filter(scorer(docs, labels)(F.coalesce("text", F.lit(""))) < 0.5)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of docs.

    Labels of held-out keys (crc32 of the key modulo 5 is 0) are not read; nothing but a text's own words goes
    into its score. Null and empty texts are scored as texts without words. Without labelled texts of both classes
    every score is the label that all labelled texts have (0 without any). Rows repeated in full are scored
    alike; an empty table gives an empty result.
    """
    scores = scorer(docs, labels)(F.coalesce("text", F.lit("")))
    out = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), scores.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
