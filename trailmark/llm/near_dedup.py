"""Near-duplicates by consistent weighted sampling.

Texts become weighted sets of shingles of five words: the weight is the count in the text times a damped inverse
document frequency. Improved consistent weighted sampling draws (shingle, level) samples, two texts agreeing on a sample with
the probability of their weighted Jaccard similarity; bands of samples make buckets of candidates. Every link is
verified by the exact weighted Jaccard similarity of the two texts, and classes are the connected components of the links.

Equal texts are one text throughout. In a bucket each text first meets the bucket's first text and the text before it,
in an order of the bucket's own; that joins most classes. What is left is exact: texts of buckets that still hold more
than one class meet by their rarest shingles. Two texts of similarity SIMILARITY share one of the rarest shingles that
make up the first part of their weight (prefix filter), so every pair of two classes that can reach SIMILARITY is
verified, whatever the size of its bucket. Document frequencies come from a sketch of fixed size that all texts are
counted into, less what other shingles in a cell are expected to add.

The inverse document frequency is damped (it moves weights by IDF_SHARE at most) because near copies raise each other's
document frequencies: with full weight, the few shingles that differ would outweigh those that a large group shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.common import discard, mix64, one_a_row, released, repeated, row_key, text_digest, without, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 15, 4
IDF_SHARE = 0.25
#: Cells of the document-frequency sketch; entries of each table of random variables.
CELLS, DRAWS = 1 << 17, 1 << 16
#: Room for rounding in the bounds of the prefix filter, as a share of a text's weight; elements of an Arrow batch.
SLACK, ELEMENTS = 1e-5, 50_000
BROADCAST_KEYS = 200_000
MOST_REMEMBERED = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's different shingles, sorted, and their counts. A text of one to four words is one shingle."""
    found = (text or "").encode("utf-8", "replace").split()
    x = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(SHINGLE, len(x))
    if not size:
        return x, np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(x) - size + 1, np.uint64)
        for k in range(size):
            out = out * _BASE + x[k : len(x) - size + 1 + k]
    return np.unique(mix64(out), return_counts=True)


class Weights:
    """Weights of shingles from the document-frequency sketch."""

    def __init__(self, cells: np.ndarray, texts: int):
        noise = (cells.sum() - cells) / (CELLS - 1)
        frequency = np.maximum(1.0, cells - noise)
        idf = np.log1p(texts / frequency) / np.log1p(max(1, texts))
        self.of_cell = (1 + IDF_SHARE * np.clip(idf, 0, 1)).astype(np.float32)

    def __call__(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.of_cell[(shingle >> np.uint64(47)).astype(np.int64)] * count.astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling. The random variables r, c ~ Gamma(2, 1) and b ~ U(0, 1) of a shingle are
    entries of fixed tables, at a place that a hash of shingle and sample number gives."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, DRAWS).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, DRAWS)).astype(np.float32)
        self.b = rng.random(DRAWS).astype(np.float32)
        self.factors = rng.integers(1, 1 << 62, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Hashes of the chosen (shingle, level), one for each sample number."""
        log_w, out = np.log(weight), np.empty(len(self.factors), np.uint64)
        step = max(1, 60_000 // len(shingle))
        for at in range(0, len(self.factors), step):
            factors = self.factors[at : at + step, None]
            place = ((shingle[None] * factors) >> np.uint64(48)).astype(np.int64)
            r, b = self.r[place], self.b[place]
            level = np.floor(log_w * self.inverse[place] + b)
            log_a = self.log_c[place] - r * (level - b + 1)
            best = np.argmin(log_a, axis=1)
            chosen = level[np.arange(len(best)), best].astype(np.int64).astype(np.uint64)
            out[at : at + step] = mix64(shingle[best] ^ mix64(chosen + np.uint64(77)))
        return out

    def bands(self, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
        rows, out = self.samples(shingle, weight).reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(ROWS):
                out = mix64(out * _BASE + rows[:, k])
        return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, weights: Weights) -> float:
    """Weighted Jaccard similarity of two texts, given as their shingles with repeats."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    u, v = weights(x, n), weights(y, m)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = float(np.minimum(u[i], v[j]).sum(dtype=np.float64))
    return both / max(1e-12, float(u.sum(dtype=np.float64) + v.sum(dtype=np.float64)) - both)


def sketch(docs: DataFrame) -> np.ndarray:
    """Document frequencies of shingles, summed in CELLS cells."""

    def run(batches):
        hashes, cells = Hashes(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = (shingles(text.as_py(), hashes)[0] >> np.uint64(47)).astype(np.int64)
                np.add.at(cells, found, 1)
        some = np.flatnonzero(cells)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(cells[some])], ["cell", "n"])

    found = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CELLS rows at most
    out = np.zeros(CELLS, np.float64)
    out[found.cell] = found.n
    return out


def copies_of(docs: DataFrame) -> DataFrame:
    """doc_id, keep: texts that are equal to the text of a smaller doc_id, and the smallest."""
    digests = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    groups = digests.groupBy("digest").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return digests.join(groups, "digest").filter(F.col("doc_id") > F.col("keep")).select("doc_id", "keep").distinct()


def buckets(docs: DataFrame, weights) -> DataFrame:
    """bucket, doc_id: the buckets of each text, those of one text left out."""

    def run(batches):
        hashes, sampler = Hashes(), Sampler()
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(batch.column(1)):
                shingle, count = shingles(text.as_py(), hashes)
                if len(shingle):
                    keys.append(sampler.bands(shingle, weights.value(shingle, count)))
                    rows.append(np.full(BANDS, i))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(np.concatenate(rows)))], ["bucket", "doc_id"])

    key = docs.schema["doc_id"].dataType.simpleString()
    every = written(docs.select("doc_id", "text").mapInArrow(run, f"bucket long, doc_id {key}").distinct(), "near-bands")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    out = written(every.join(shared, "bucket"), "near-buckets")
    discard(every)
    return out


def pairs(members: DataFrame, turn: int) -> DataFrame:
    """a < b: each member of a bucket with the bucket's first text and with the text before it. The first text and the order
    come from a hash with the bucket and the turn, so that other buckets and turns compare other pairs."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("doc_id", "bucket", F.lit(turn)).alias("h"), "doc_id")).alias("first")).filter("n > 1")
    joined = members.join(sizes, "bucket")
    star = joined.select(F.least("doc_id", "first.doc_id").alias("a"), F.greatest("doc_id", "first.doc_id").alias("b")).filter("a < b")
    # The order within a bucket is cut into runs of about 64 texts by hash, so that no window holds a whole bucket.
    run = F.pmod(F.xxhash64("doc_id", F.lit(turn), F.col("bucket")), F.ceil(F.col("n") / 64).cast("int"))
    order = Window.partitionBy("bucket", "run").orderBy(F.xxhash64("doc_id", "bucket", F.lit(turn)), "doc_id")
    chain = joined.filter("n > 2").withColumn("run", run).withColumn("other", F.lag("doc_id").over(order)).filter("other is not null")
    chain = chain.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).filter("a < b")
    return star.unionByName(chain).distinct()


def rarest(each: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray, float]:
    """The elements of a text that the prefix filter needs, rarest first, with the weight from each of them on, and the
    weight of the text. each: shingles with repeats; the repeats of a shingle are elements of their own."""
    x, n = np.unique(each, return_counts=True)
    element, weight = np.repeat(x, n), np.repeat(weights(x, np.ones_like(n)), n).astype(np.float64)
    nth = np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        element = np.where(nth == 0, element, mix64(element + nth.astype(np.uint64) * _BASE))
    order = np.lexsort((element, -weight))
    element, weight = element[order], weight[order]
    size = float(weight.sum())
    rest = size - (np.cumsum(weight) - weight)
    some = rest >= (SIMILARITY - SLACK) * size
    return element[some], rest[some], size


def by_rarest(texts: DataFrame, weights) -> DataFrame:
    """a < b: all pairs of texts of different classes that can reach SIMILARITY. texts: doc_id, root, shingles.

    Of weights A >= B, a similarity of t takes a shared weight of t / (1 + t) * (A + B), which is t * A and 2 t / (1 + t) * B
    at least. From the rarest shared element on, both texts must have that much weight left: it lies in the first part of
    either, a shorter one for the lighter text."""
    key, share = texts.schema["doc_id"].dataType.simpleString(), SIMILARITY / (1 + SIMILARITY)

    def run(batches):
        for batch in batches:
            held, n = [], 0
            for i, each in enumerate(batch.column(2)):
                element, rest, size = rarest(np.frombuffer(each.as_py(), np.uint64), weights.value)
                held.append((i, element, rest, size))
                n += len(element)
                if n >= ELEMENTS or i == batch.num_rows - 1:
                    times = [len(h[1]) for h in held]
                    at = pa.array(np.repeat([h[0] for h in held], times))
                    rest, size = np.concatenate([h[2] for h in held]), np.repeat([h[3] for h in held], times)
                    element = pa.array(np.concatenate([h[1] for h in held]).view(np.int64))
                    short = pa.array(rest >= (2 * share - SLACK) * size)
                    yield pa.record_batch([element, batch.column(0).take(at), batch.column(1).take(at), pa.array(size), pa.array(rest), short], ["element", "doc_id", "root", "size", "rest", "short"])
                    held, n = [], 0

    every = written(texts.select("doc_id", "root", "shingles").mapInArrow(run, f"element long, doc_id {key}, root {key}, size double, rest double, short boolean"), "near-rarest")
    shared = every.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("short").alias("any")).filter("any and low != high").select("element")
    some = written(every.join(shared, "element"), "near-shared")
    discard(every)
    x, y = some.filter("short").alias("x"), some.alias("y")
    lighter = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.doc_id") < F.col("y.doc_id")))
    both = F.col("x.size") + F.col("y.size")
    enough = F.least("x.rest", "y.rest") >= F.lit(share - SLACK) * both
    met = x.join(y, (F.col("x.element") == F.col("y.element")) & (F.col("x.root") != F.col("y.root")) & lighter & enough)
    out = written(met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), "near-met")
    discard(some)
    return out


def verified(edges: DataFrame, sets: DataFrame, weights) -> DataFrame:
    """a, b, similarity of the pairs whose weighted Jaccard similarity reaches SIMILARITY."""

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            values = np.array([similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), weights.value) for p, q in zip(x, y, strict=True)], float)
            good = pa.array(values >= SIMILARITY)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(values)], ["a", "b", "similarity"]).filter(good)

    key = sets.schema["doc_id"].dataType.simpleString()
    both = edges.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, f"a {key}, b {key}, similarity double")


def components(links: DataFrame) -> DataFrame:
    """doc_id, root: for each text with a link the smallest text that it is linked to, directly or not. Smallest
    neighbours spread while roots point to their own roots; each turn is written."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-links")
    roots = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("doc_id"), "root"), "near-roots")
    while True:
        spread = both.join(roots.select(F.col("doc_id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("r").alias("r"))
        nearer = roots.join(spread, "doc_id").select("doc_id", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jump = nearer.select(F.col("doc_id").alias("root"), F.col("root").alias("next"))
        new = written(nearer.join(jump, "root", "left").select("doc_id", F.least("root", F.coalesce("next", "root")).alias("root"), "was"), "near-roots")
        changed = not new.filter("root != was").isEmpty()
        discard(roots)
        roots = new
        if not changed:
            discard(both)
            return roots.select("doc_id", "root")


def merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots with the classes joined that the new links join. Only the graph of classes is walked again, not that of texts."""
    every = roots.unionByName(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(roots, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("root")))
    every = written(every, "near-roots")
    a, b = (every.select(F.col("doc_id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    between = found.select("a", "b").join(a, "a").join(b, "b").filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    between = components(between).select(F.col("doc_id").alias("root"), F.col("root").alias("new"))
    out = written(every.join(between, "root", "left").select("doc_id", F.coalesce("new", "root").alias("root")), "near-roots")
    discard(every)
    return out


def link(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between different texts and the roots of their components."""
    cells, texts = sketch(docs), docs.count()
    weights = spark.sparkContext.broadcast(Weights(cells, texts))
    members = buckets(docs, weights)
    wanted = written(members.select("doc_id").distinct(), "near-wanted")

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            sets = [np.repeat(*shingles(t.as_py(), hashes)).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    key = docs.schema["doc_id"].dataType.simpleString()
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    sets = written(docs.select("doc_id", "text").join(few, "doc_id", "left_semi").mapInArrow(run, f"doc_id {key}, shingles binary").dropDuplicates(["doc_id"]), "near-sets")
    # First one candidate for each text: most others then lie within one class.
    first = written(pairs(members, 0), "near-pairs")
    tested = written(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "near-edges")
    links = written(verified(tested, sets, weights), "near-found")
    roots = components(links)
    released(spark)

    def apart(edges: DataFrame) -> DataFrame:
        a, b = (roots.select(F.col("doc_id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        return edges.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def by_class() -> DataFrame:
        return members.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))

    def representatives() -> DataFrame:
        one = by_class().groupBy("bucket", "root").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(2)).alias("h"), "doc_id")).alias("x"))
        return pairs(one.select("bucket", "x.doc_id"), 2)

    def rest() -> DataFrame:
        """All that the rounds before have left open: texts in buckets of more than one class."""
        mixed = by_class().groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
        texts = by_class().join(mixed, "bucket").select("doc_id", "root").distinct()
        return by_rarest(texts.join(sets, "doc_id"), weights)

    for candidates in (lambda: apart(first), representatives, rest):
        edges = written(candidates().join(tested, ["a", "b"], "left_anti"), "near-edges")
        found = written(verified(edges, sets, weights), "near-found")
        tested, links = tested.unionByName(edges), links.unionByName(found)
        if not found.isEmpty():
            roots = merged(roots, found)
        released(spark)
    discard(sets, members, wanted, first)
    weights.destroy()
    return links, roots


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, copy_of, one row for each different key of docs.

    class_id is the smallest key of the class; copy_of the smallest key with the same text. Classes are the connected
    components of links of at least SIMILARITY. Null texts count as empty; texts without words link only to equal
    texts. A null key has a class of its own (null). Rows repeated in full are one row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    keyed = rows.filter("doc_id is not null")
    copies = written(copies_of(keyed), "near-copies")
    only = F.broadcast(copies.select("doc_id")) if copies.count() <= BROADCAST_KEYS else copies.select("doc_id")
    _, roots = link(spark, keyed.join(only, "doc_id", "left_anti"))
    out = rows.select("doc_id").distinct().join(copies, "doc_id", "left").withColumn("copy_of", F.coalesce("keep", "doc_id")).drop("keep")
    out = out.join(roots.select(F.col("doc_id").alias("copy_of"), "root"), "copy_of", "left").withColumn("class_id", F.coalesce("root", "copy_of"))
    sizes = out.groupBy(F.col("class_id").alias("c")).agg(F.count(F.lit(1)).alias("class_size"))
    return out.join(sizes, F.col("class_id").eqNullSafe(F.col("c"))).select("doc_id", "class_id", "class_size", "copy_of")


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one text of each class: the one with the smallest key. Where keys repeat or are null, rows are
    judged by key and text, null keys last; rows that are equal in both are one row."""
    again = repeated(docs, key)
    plain = again.isEmpty()
    rows = docs if plain else docs.withColumn("_row", row_key(F.col(key), text_digest(text)))
    row = key if plain else "_row"
    found = near_dedup(rows, row, text).filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("gone"))
    left = without(rows, written(found, "near-gone"), row)
    return left if plain else one_a_row(left, again, row, key).drop(row)
