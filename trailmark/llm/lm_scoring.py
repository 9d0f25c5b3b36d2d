"""Language-model scores from a log-bilinear neural model.

Counts of all training words come from the whole corpus. The model predicts the class of the next token from the two
tokens before it: the most frequent words and the end are classes of their own, other words fall into classes by
their first bytes, and within such a class a word has its smoothed share of the corpus counts. For context tokens
u, v a class w has the logit (C1 r_u + C2 r_v) . q_w + b_w; the parameters are trained in numpy with
noise-contrastive estimation. They start from a bounded sample; then every task carries them through all training texts
of its partition, and the average of the tasks' parameters, weighted by tokens, is the model. Batched matrix products
over all contexts give the normalisers once, so that a token costs three look-ups.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import hash_sample, remainder, written

#: Words that are classes of their own, classes of other words, width of the embeddings.
TOP_WORDS, OTHER_CLASSES, WIDTH = 1000, 64, 32
#: Words whose counts every task holds; the counts of all others meet their words in a join.
HELD_WORDS = 60_000
#: The bounded sample that the neural part starts from; after it, all training texts are learnt from.
SAMPLE_TEXTS, SAMPLE_CHARS = 2500, 40_000
EPOCHS, BATCH, NOISE, RATE = 3, 2048, 128, 0.003
#: The pass over all training texts: contexts a step, drawn noise classes, step size, contexts that are shuffled together.
PASS_BATCH, PASS_NOISE, PASS_RATE, PASS_HELD = 4096, 128, 0.0005, 1 << 17
#: Distinct words that a counting task holds before it passes them on.
MOST_COUNTED = 400_000
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case. bytes.lower() and bytes.split() do just that."""
    return (text or "").encode("utf-8", "replace").lower().split()


def count_tokens(docs: DataFrame) -> DataFrame:
    """word (binary, empty for the end), c: occurrences in all texts of docs. Each task sums up before the shuffle."""

    def run(batches):
        counts: dict[bytes, int] = {}

        def out():
            return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for word in (found := tokens(text.as_py())):
                    counts[word] = counts.get(word, 0) + 1
                counts[END] = counts.get(END, 0) + 1
                if len(counts) >= MOST_COUNTED or len(found) >= MOST_COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame) -> DataFrame:
    """The words with the highest counts, HELD_WORDS at most: those above a count that a histogram over eighths of powers
    of two gives, so that tasks pass on only words that are held."""
    words = counts.filter(F.length("word") > 0)
    step = F.floor(F.log2("c") * 8)
    held, least = 0, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.step):  # 512 rows at most
        held += r.n
        if held > HELD_WORDS:
            least = r.step + 1
            break
    return words.filter(step >= least)


def other_class(word: bytes) -> int:
    return zlib.crc32(word[:2]) % OTHER_CLASSES


def contexts(sequences: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the classes of the token before it, of the one before that, and its own. Class `size` stands for what
    precedes a text."""
    padded = [np.concatenate([[size, size], s]) for s in sequences]
    return tuple(np.concatenate([np.zeros(0, np.int64), *(p[k : len(p) - 2 + k] for p in padded)]).astype(np.int64) for k in (1, 0, 2))


class Learner:
    """The parameters r, q, c1, c2, b, with one step of noise-contrastive estimation (by Adam) at a time.

    Both places of the context share the words' embeddings r; c1 and c2 set them apart."""

    def __init__(self, params: list[np.ndarray], noise: np.ndarray, drawn: int, rate: float, seed):
        self.params, self.noise, self.drawn, self.rate = params, noise, drawn, rate
        self.rng = np.random.default_rng(seed)
        self.first, self.second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        self.log_noise, self.cumulative, self.steps = np.log(drawn * noise).astype(np.float32), np.cumsum(noise), 0

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        r, q, c1, c2, b = self.params
        size = len(q)
        k = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.drawn)), size - 1)
        ru, rv = r[u], r[v]
        hidden = ru @ c1 + rv @ c2
        seen = (hidden * q[w]).sum(1) + b[w] - self.log_noise[w]
        drawn = hidden @ q[k].T + b[k] - self.log_noise[k]
        # Derivatives of the log-likelihood of telling data from noise.
        d_seen = 1 / (1 + np.exp(np.clip(seen, -30, 30)))
        d_drawn = -1 / (1 + np.exp(-np.clip(drawn, -30, 30)))
        d_hidden = d_seen[:, None] * q[w] + d_drawn @ q[k]
        to_q = summed(w, d_seen[:, None] * hidden, size) + summed(k, d_drawn.T @ hidden, size)
        to_b = np.bincount(w, d_seen, size) + np.bincount(k, d_drawn.sum(0), size)
        to_r = summed(u, d_hidden @ c1.T, size + 1) + summed(v, d_hidden @ c2.T, size + 1)
        grads = [to_r, to_q, ru.T @ d_hidden, rv.T @ d_hidden, to_b]
        self.steps += 1
        for p, g, m, s in zip(self.params, grads, self.first, self.second, strict=True):
            g = (g / len(u)).astype(np.float32)
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p += self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)

    def learn(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, batch: int) -> None:
        """Steps through all of these contexts in a random order."""
        order = self.rng.permutation(len(target))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            self.step(one[rows], two[rows], target[rows])


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that go to each of `size` places."""
    width = rows.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), rows.ravel(), size * width).reshape(size, width)


def start(sequences: list[np.ndarray], size: int, seed: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """Parameters learnt from a sample (classes of the tokens of each text), and the noise distribution."""
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.concatenate([*sequences, np.arange(size)]), minlength=size).astype(np.float64)
    noise = counts / counts.sum()
    r, q = (rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32) for n in (size + 1, size))
    c1, c2 = (np.eye(WIDTH, dtype=np.float32) for _ in range(2))
    learner = Learner([r, q, c1, c2, np.log(noise).astype(np.float32)], noise, NOISE, RATE, seed + 1)
    for _ in range(EPOCHS):
        learner.learn(*contexts(sequences, size), BATCH)
    return learner.params, noise


def logits(params: list[np.ndarray]) -> dict[str, np.ndarray]:
    """s1, s2 (what a context token one or two back adds to each class) and b."""
    r, q, c1, c2, b = params
    return {"s1": r @ c1 @ q.T, "s2": r @ c2 @ q.T, "b": b}


def train(sequences: list[np.ndarray], size: int, seed: int = 0) -> dict[str, np.ndarray]:
    """The model of a bounded list of texts alone."""
    return logits(start(sequences, size, seed)[0])


def learnt_from_all(texts: DataFrame, params: list[np.ndarray], noise: np.ndarray, classes_of) -> list[np.ndarray]:
    """The parameters after a pass over the column `text` of texts: each task goes on from params through the whole texts
    of its partition, and the tasks' parameters are averaged by their tokens.

    classes_of(text) gives the classes of a text's tokens. Tasks send one number for each parameter, whatever they read;
    the sums are native aggregates, and the driver gets one row for each parameter. Without texts params come back."""
    spark, sizes = texts.sparkSession, [p.size for p in params]
    begin = spark.sparkContext.broadcast((params, noise))

    def run(batches):
        params, noise = begin.value
        learner = Learner([p.copy() for p in params], noise, PASS_NOISE, PASS_RATE, TaskContext.get().partitionId())
        held, n, total = [], 0, 0

        def learn():
            learner.learn(*contexts(held, len(noise)), PASS_BATCH)
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                # A piece of a very long text goes on without the two tokens before it.
                found = classes_of(text.as_py())
                total += len(found)
                for at in range(0, len(found), PASS_HELD):
                    held.append(found[at : at + PASS_HELD])
                    n += len(held[-1])
                    if n >= PASS_HELD:
                        learn()
                        n = 0
        if held:
            learn()
        if total:
            flat = np.concatenate([p.ravel() for p in learner.params]).astype(np.float64) * total
            yield pa.record_batch([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), total, np.int64))], ["place", "value", "n"])

    moved = texts.select("text").mapInArrow(run, "place int, value double, n long")
    average = written(moved.groupBy("place").agg((F.sum("value") / F.sum("n")).alias("value")), "lm-parameters").toPandas()  # one row a parameter
    begin.destroy()
    if not len(average):
        return params
    flat = average.sort_values("place").value.to_numpy(np.float32)
    return [part.reshape(p.shape) for part, p in zip(np.split(flat, np.cumsum(sizes)[:-1]), params, strict=True)]


def normalisers(model: dict[str, np.ndarray]) -> np.ndarray:
    """log Z for every pair of context tokens: with e^S1 and e^S2 the sums over classes are one matrix product."""
    top1, top2 = model["s1"].max(1, keepdims=True), model["s2"].max(1, keepdims=True)
    with np.errstate(under="ignore"):
        z = (np.exp(model["s1"] - top1) * np.exp(model["b"] - model["b"].max())) @ np.exp(model["s2"] - top2).T
    return (np.log(np.maximum(z, 1e-37)) + top1 + top2.T + model["b"].max()).astype(np.float32)


class Held(dict):
    """A word's place among the held words; for others -1 less their class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - other_class(word)


class Vocabulary:
    """The held words and their classes, from a broadcast; every process builds its own dictionary once."""

    def __init__(self, shared, end_class: int):
        self.shared, self.end_class, self.held = shared, end_class, None

    def __getstate__(self):
        return self.__dict__ | {"held": None}

    def places(self, found: list[bytes]) -> np.ndarray:
        if self.held is None:
            self.held = Held({w: i for i, w in enumerate(self.shared.value[0])})
        return np.fromiter(map(self.held.__getitem__, found), np.int64, len(found))

    def classes(self, place: np.ndarray) -> np.ndarray:
        own = self.shared.value[1]
        return np.where(place >= 0, own[np.maximum(place, 0)] if len(own) else 0, self.end_class - place)


def score(docs: DataFrame, fold: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row for each row of docs.

    Training texts are those whose crc32(doc_id as text) modulo fold is not held_out (a null key counts as the empty
    text). Null texts count as empty: one token, the end. Scores are log10 probabilities; words that training did not
    see share the probability of one word of their class that was seen no time. Rows repeated in full are scored
    alike, and counted as often as they occur. An empty table gives an empty result; without training texts every
    base probability is 1 and classes are equally likely.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), fold) == held_out).alias("held_out"))
    counts = written(count_tokens(rows.filter(~F.col("held_out"))), "lm-counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    n_ends = int(counts.filter(F.col("word") == F.lit(bytearray(END))).agg(F.sum("c")).first()[0] or 0)
    top = frequent(counts).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)  # HELD_WORDS at most
    top["word"] = top.word.map(bytes)
    size = min(TOP_WORDS, len(top)) + 1 + OTHER_CLASSES  # top words, the end, classes of other words
    end_class = min(TOP_WORDS, len(top))
    classes = np.array([i if i < end_class else end_class + 1 + other_class(w) for i, w in enumerate(top.word)], np.int64)
    # Occurrences and words of each class of other words: over all words less those that are classes of their own.
    by_class = counts.filter(F.length("word") > 0).groupBy((F.crc32(F.expr("substring(word, 1, 2)")) % OTHER_CLASSES).alias("k")).agg(F.sum("c"), F.count(F.lit(1))).collect()
    class_n, class_v = np.zeros(OTHER_CLASSES), np.zeros(OTHER_CLASSES)
    for k, a, d in by_class:  # at most OTHER_CLASSES rows
        class_n[k], class_v[k] = a, d
    for word, c in zip(top.word[:end_class], top.c[:end_class], strict=True):
        class_n[other_class(word)] -= c
        class_v[other_class(word)] -= 1
    log_class = np.log10(class_n + class_v + 1)

    shared_words = spark.sparkContext.broadcast((list(top.word), classes))
    vocabulary = Vocabulary(shared_words, end_class)

    def classes_of(text: str | None) -> np.ndarray:
        found = tokens(text)
        return np.append(vocabulary.classes(vocabulary.places(found)), end_class)

    training = rows.filter(~F.col("held_out")).select("doc_id", "text")
    sample = hash_sample(training.filter(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS), SAMPLE_TEXTS, "doc_id")
    texts = sample.toPandas().sort_values(["doc_id", "text"]).text  # bounded
    params, noise = start([classes_of(t) for t in texts], size)
    model = logits(learnt_from_all(training, params, noise, classes_of))
    ln10 = math.log(10)
    log_z, s1, s2, b = (x.astype(np.float32) / np.float32(ln10) for x in (normalisers(model), model["s1"], model["s2"], model["b"]))
    c = top.c.to_numpy(np.float64)
    log_base = np.log10(n + (v + 1))
    base_of = np.log10(c + 1) - log_base
    own_of = np.where(np.arange(len(c)) < end_class, 0.0, np.log10(c + 1) - log_class[np.maximum(classes - end_class - 1, 0)])
    shared = spark.sparkContext.broadcast((base_of, own_of, log_class, log_z, s1, s2, b))
    base_end, known_end = math.log10(n_ends + 1) - log_base, int(n_ends > 0)

    def run(batches):
        base_of, own_of, log_class, log_z, s1, s2, b = shared.value
        made, task = 0, TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                cols = {x: [] for x in ("row", "n_tokens", "n_known", "base", "score")}
                words, times, ends = [], [], [0]
                for text in batch.column(1):
                    found = tokens(text.as_py())
                    place = vocabulary.places(found)
                    known, group = place >= 0, vocabulary.classes(place)
                    path = np.concatenate([[size, size], group, [end_class]])
                    u, x, w = path[1:-1], path[:-2], path[2:]
                    model_score = (s1[u, w].astype(np.float64) + s2[x, w] + b[w] - log_z[u, x]).sum()
                    rare = {}
                    if len(found) != known.sum():
                        for i in np.flatnonzero(~known):
                            rare[found[i]] = rare.get(found[i], 0) + 1
                    n_rare = len(found) - int(known.sum())
                    cols["row"].append(task + made)
                    made += 1
                    cols["n_tokens"].append(len(found) + 1)
                    cols["n_known"].append(int(known.sum()) + known_end)
                    cols["base"].append(float(base_of[place[known]].sum() + base_end - n_rare * log_base))
                    cols["score"].append(float(model_score + own_of[place[known]].sum() - log_class[-1 - place[~known]].sum()))
                    words += rare
                    times += rare.values()
                    ends.append(len(words))
                pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                numbers = [pa.array(cols[x], t) for x, t in (("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()))]
                yield pa.record_batch([batch.column(0), batch.column(2), *numbers, rare], ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "rare"])

    key = docs.schema["doc_id"].dataType.simpleString()
    spec = f"doc_id {key}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, n: long>>"
    parts = written(rows.select("doc_id", "text", "held_out").mapInArrow(run, spec), "lm-parts")
    shared.destroy()
    shared_words.destroy()
    met = parts.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    more = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 1)).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("seen"))
    out = parts.drop("rare").join(more, "row", "left")
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
