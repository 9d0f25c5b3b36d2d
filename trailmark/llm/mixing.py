"""Mixing sources to target weights.

Each source's texts form one stream of words, cut into blocks of a fixed number of words. The mix has a target
share for each source; every output shard draws its source counts from a multinomial distribution. A slot of a
source is mapped to a block through a pseudorandom permutation of the source's block indexes (a Feistel network
keyed by source and pass over the source), and slots meet blocks in a join by (source, block index).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import WORD_GAP, mix64, n_words, written

#: Words a block, weights by rank of the source, times a source may be taken.
BLOCK_WORDS = 64
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Slots a shard has at least, and shards at most (what the driver draws for; shards grow instead beyond that).
SHARD_SLOTS = 4096
MOST_SHARDS = 1024
#: Rows that one window over a part of a source holds, on average.
PART_ROWS = 4000


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, cap, target: shares of all words by weight, none above its cap.

    Sources rank by code point, null last. The level that fills every source to min(cap, weight * level) is found
    in closed form: with sources ordered by cap / weight, those before the first whose cap exceeds the level are
    full. Works on one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.col("rank") % len(WEIGHTS) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(MOST_TIMES)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    found = ranked.withColumn("level", level).withColumn("open", F.col("weight") * F.col("level") <= F.col("cap"))
    found = found.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"])
    target = F.least("cap", F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return found.select("source", "rank", "source_size", "weight", "cap", target.alias("target"))


def placed(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """doc_id, source, size, start: where each text's words begin in its source's stream.

    The order is by a hash of the key, then key, size. Sums run in two steps, parts of a source and texts of a
    part, so that a source with a third of all rows is shared out."""
    sizes = written(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "mix-sizes")
    parts = max(16, sizes.count() // PART_ROWS)
    sizes = sizes.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    sums = sizes.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(up_to), F.lit(0)).alias("begin"))
    inner = Window.partitionBy("source", "part").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    out = within.join(begins, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return written(out.select("doc_id", "source", "size", (F.col("begin") + F.col("inner")).alias("start")), "mix-placed")


def draw(quotas: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Source counts of each shard. A shard draws from a multinomial distribution over what is left of the quotas
    (so errors of early shards are made up by later ones); the last shard takes what then remains."""
    rng, left, out = np.random.default_rng(seed), quotas.astype(np.int64).copy(), []
    shard = max(SHARD_SLOTS, -(-int(left.sum()) // MOST_SHARDS))
    while left.sum() > shard:
        got = np.minimum(rng.multinomial(shard, left / left.sum()), left)
        out.append(got)
        left = left - got
    return [*out, left] if left.sum() else out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key, at index; all arrays of one length.

    A balanced Feistel network over the next even number of bits, walked until the value is below n."""
    half = (np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2))).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo, n = index.astype(np.uint64), np.arange(len(index)), n.astype(np.uint64)
    while len(todo):
        left, right = value[todo] >> half[todo], value[todo] & mask[todo]
        for turn in range(4):
            left, right = right, left ^ (mix64(right ^ mix64(key[todo] + np.uint64(turn + 1))) & mask[todo])
        value[todo] = (left << half[todo]) | right
        todo = todo[value[todo] >= n[todo]]
    return value.astype(np.int64)


def slots(spark, shares: pd.DataFrame, seed: int = 0) -> DataFrame:
    """shard, slot, rank (of the source), block, turn: the mix itself, one row for each slot.

    shares: rank, source_size, target, one row for each source."""
    shares = shares[shares.source_size > 0]
    blocks = -(-shares.source_size.to_numpy() // BLOCK_WORDS)
    exact = shares.target.to_numpy(float) * blocks / np.maximum(shares.source_size.to_numpy(), 1)
    quotas = np.minimum(np.rint(exact).astype(np.int64), MOST_TIMES * blocks)
    rows, taken = [], np.zeros(len(quotas), np.int64)
    for shard, counts in enumerate(draw(quotas, seed)):
        first = np.cumsum(counts) - counts
        rows += [(shard, int(first[i]), int(r), int(taken[i]), int(counts[i]), int(blocks[i])) for i, r in enumerate(shares["rank"]) if counts[i]]
        taken += counts
    spec = "shard int, first long, rank long, begin long, n long, blocks long"
    drawn = spark.createDataFrame(rows, spec) if rows else spark.createDataFrame([], spec)
    # Long runs of slots of one source are cut, so that no task makes more than its share.
    cut = drawn.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1024).cast("long"))))
    cut = cut.repartition("shard", "rank", "at")

    def mapped(frames):
        for frame in frames:
            size = np.minimum(1024, frame.n - frame["at"]).to_numpy()
            row = np.repeat(np.arange(len(frame)), size)
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + frame["at"].to_numpy()[row]
            j, n, rank = frame.begin.to_numpy()[row] + step, frame.blocks.to_numpy()[row], frame["rank"].to_numpy()[row]
            turn = j // n
            key = mix64(rank.astype(np.uint64) * np.uint64(1 << 20) + turn.astype(np.uint64) + np.uint64(seed))
            yield pd.DataFrame({"shard": frame.shard.to_numpy()[row], "slot": frame["first"].to_numpy()[row] + step, "rank": rank, "block": permuted(j % n, n, key), "turn": turn})

    return cut.mapInPandas(mapped, "shard int, slot long, rank long, block long, turn long")


def pieces(rows: DataFrame) -> DataFrame:
    """Each text's share of each block: rank, block, piece_from, piece_to (words of the text), one row for each."""
    size = F.lit(BLOCK_WORDS)
    some = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size))))
    piece_from = F.greatest(F.col("block") * size, F.col("start")) - F.col("start")
    piece_to = F.least((F.col("block") + 1) * size, F.col("start") + F.col("size")) - F.col("start")
    return some.withColumns({"piece_from": piece_from, "piece_to": piece_to})


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and parts, one row for each row of docs.

    parts: array of (piece_from, piece_to, times), the words of the text that the mix takes and how often, in
    order; taken is their sum. No block, and so no text, is taken more than MOST_TIMES times. Null and blank
    texts have size 0 and take part in nothing; a null source is a source of its own, ranked last; rows repeated
    in full are texts of their own, but for blank ones nothing tells them apart. Results depend on the rows, not
    on their order or partitions. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = placed(docs, key, text, source)
    shares = written(targets(rows.select("source", "size")), "mix-targets")
    ranks = shares.select(F.col("source").alias("s"), "rank", "source_size", "target")
    rows = rows.join(F.broadcast(ranks) if shares.count() <= 50_000 else ranks, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    drawn = slots(spark, shares.select("rank", "source_size", "target").orderBy("rank").toPandas(), seed)
    times = drawn.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    own = ["rank", "start", "doc_id", "source", "size", "source_size", "target"]
    part = F.when(F.col("times").isNotNull(), F.struct("piece_from", "piece_to", "times"))
    met = pieces(rows).join(times, ["rank", "block"], "left").groupBy(*own).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + (p["piece_to"] - p["piece_from"]) * p["times"])
    met = met.withColumn("taken", taken)
    none = rows.filter("size = 0").select(*own).withColumns({"parts": F.array().cast(met.schema["parts"].dataType), "taken": F.lit(0).cast("long")})
    return met.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken", "parts")


def mixed_text(text: Column, parts: Column) -> Column:
    """The taken words of a text. Copy c has the parts that are taken c times or more, in order: the text as it is if
    those are all, else their words joined by one space. Copies follow each other on lines of their own."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")

    def copy(c: int) -> Column:
        chosen = F.filter(parts, lambda p: p["times"] >= c)
        some = F.flatten(F.transform(chosen, lambda p: F.slice(words, (p["piece_from"] + 1).cast("int"), (p["piece_to"] - p["piece_from"]).cast("int"))))
        last = F.element_at(parts, -1)["piece_to"]
        taken = F.aggregate(chosen, F.lit(0).cast("long"), lambda a, p: a + p["piece_to"] - p["piece_from"])
        return F.when(taken == n_words(text), text).when((taken > 0) & last.isNotNull(), F.array_join(some, " "))

    return F.array_join(F.array(*[copy(c) for c in range(1, MOST_TIMES + 1)]), "\n")


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars", seed: int = 0) -> DataFrame:
    """docs, all columns, with the words that the mix takes as text (and their number of characters, if docs has that
    column); texts of which nothing is taken go. Rows that share a key are told apart by source and size."""
    taken = mix(docs, key, text, source, seed).filter("taken > 0")
    taken = taken.select(F.col("doc_id").alias("k"), F.col("source").alias("s"), F.col("size").alias("z"), "parts")
    # Rows with the same key, source and size have the same place among those of their key on both sides.
    own = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(source).alias("s"), n_words(F.col(text)).alias("z")).filter("z > 0")
    join = F.col("k").eqNullSafe(F.col("k2")) & F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2")) & (F.col("i") == F.col("i2"))
    same = Window.partitionBy("k", "s", "z").orderBy(F.xxhash64(f"row.{text}"))
    taken = taken.withColumn("i", F.row_number().over(Window.partitionBy("k", "s", "z").orderBy("parts"))).select(*[F.col(c).alias(f"{c}2") for c in ("k", "s", "z", "i")], "parts")
    met = own.withColumn("i", F.row_number().over(same)).join(taken, join)
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    out[text] = mixed_text(F.col(f"row.`{text}`"), F.col("parts"))
    if chars in out:
        out[chars] = F.length(out[text]).cast(docs.schema[chars].dataType)
    return met.select(*[c.alias(n) for n, c in out.items()])
