"""Personal data: fixed formats, and candidates judged by gradient-boosted trees; DataFrame functions only.

Every kind has a fixed format with a check (the base). Beside it, generators with high recall propose spans, which
may overlap; features of their format and context go to boosted trees, and spans whose score reaches the calibrated
threshold are added. The trees are trained in numpy and evaluated as expressions, so that no text leaves the JVM. What they
learn from does not equate "no base span" with "no personal data": positive examples are base spans rewritten to the wider
forms of the generators (their checks still hold), negative ones are the same forms with failing checks, dates made of
their digits, forms inside longer words, and what the generators propose in the corpus beside base spans.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import discard, hash_sample, written

KINDS = ("email", "ip", "card", "phone")
#: The base formats. Possessive repeats and starts only where a run starts (or the match before ended)
#: find the same matches as the plain patterns, in time linear in the text and without recursion.
_RUN = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_RUN}]))[{_RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates.
WIDE = {
    "email": rf"(?<![{_RUN}])[{_RUN}]{{1,64}}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:\x20?[.]\x20?[0-9]{1,4}+){3,7}+",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?+[0-9]){12,18}+",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]\(?[0-9]{2,4}(?![0-9]|\.[0-9])\)?){2,4}",
}
#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": "[@]|[(\\[]at[)\\]]", "ip": "[0-9][.][0-9]|[0-9]\x20?[.]\x20?[0-9]", "card": "[0-9]", "phone": "[0-9]"}
CUES = "(?i)mail|tel|phone|call|fax|mobile|card|visa|pay|host|addr|server|contact"
#: Characters looked at on each side of a candidate.
CONTEXT = 24
#: The bounded sample of texts, and of examples of each kind in them, both drawn by hash, that train the trees.
SAMPLE_TEXTS, SAMPLE_CANDIDATES = 4000, 20_000
#: Spans that are put away together.
BLOCK = 128
TREES, RATE, LEAST_LEAF = 24, 0.3, 20
#: The precision that added spans must reach on the candidates held back for calibration.
PRECISION = 0.98
EMPTY = "array<struct<start:int,stop:int>>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits pass: from the right, every second one doubled, digits of the doubles added."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d, i: (d.try_cast("int") * (1 + i % 2)) - F.when((i % 2 == 1) & (d.try_cast("int") > 4), 9).otherwise(0))
    return F.aggregate(values, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    size = F.length(digits(match))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": size.between(16, 19) & F.when(size.between(16, 19), luhn(digits(match))).otherwise(False),
        "phone": size.between(8, 15),
    }[kind]


def base_spans(text: Column, kind: str) -> Column:
    return located(text, BASE[kind], lambda m: passes(kind, m), NEEDS[kind])


def _push(state: Column, item: Column, at: Column) -> Column:
    """state (at, block, full) with item added. Full blocks are put away, so that a text of many spans does not copy all
    of them for each one."""
    one = F.array(item)
    filled = F.size(state["block"]) >= BLOCK
    block = F.when(filled, one).otherwise(F.concat(state["block"], one))
    full = F.when(filled, F.concat(state["full"], F.array(state["block"]))).otherwise(state["full"])
    return F.struct(at.alias("at"), block.alias("block"), full.alias("full"))


def _empty(at: Column) -> Column:
    return F.struct(at.alias("at"), F.array().cast(EMPTY).alias("block"), F.array().cast(f"array<{EMPTY}>").alias("full"))


def _all_of(state: Column) -> Column:
    return F.concat(F.flatten(state["full"]), state["block"])


def located(text: Column, pattern: str, keep, need: str) -> Column:
    """start and stop (code points, stop exclusive) of the matches that keep() is true for, in order.

    The matches and the text between them, both in order, give the places: no match is looked for again."""
    holds = text.rlike(need)
    gaps = F.transform(F.when(holds, F.split(text, pattern, -1)), F.length)
    pieces = F.arrays_zip(gaps.alias("gap"), F.when(holds, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("m"))
    pieces = F.filter(pieces, lambda p: p["m"].isNotNull())

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        stop = start + F.length(p["m"])
        span = F.struct(start.alias("start"), stop.alias("stop"))
        return F.when(keep(p["m"]), _push(a, span, stop)).otherwise(F.struct(stop.alias("at"), a["block"].alias("block"), a["full"].alias("full")))

    return F.coalesce(F.aggregate(pieces, _empty(F.lit(0)), step, _all_of), F.array().cast(EMPTY))


def apart(found: Column, base: Column) -> Column:
    """Spans of found that share no characters with base spans; found in order and without overlaps. One sweep over both, by start."""

    def tagged(spans: Column, own: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(own).alias("own")))

    every = F.array_sort(F.concat(tagged(found, True), tagged(base, False)))
    reach = F.aggregate(every, _empty(F.lit(0)), lambda a, s: F.when(s["own"] & (s["start"] >= a["at"]), _push(a, F.struct(s["start"].alias("start"), s["stop"].alias("stop")), a["at"])).otherwise(
        F.struct(F.when(s["own"], a["at"]).otherwise(F.greatest(a["at"], s["stop"])).alias("at"), a["block"].alias("block"), a["full"].alias("full"))), _all_of)
    # What begins after the base spans before it must also end before the next one: the same sweep from the end.
    back = F.reverse(F.array_sort(F.concat(F.transform(reach, lambda s: F.struct(s["stop"].alias("stop"), s["start"].alias("start"), F.lit(True).alias("own"))), F.transform(base, lambda s: F.struct(s["stop"].alias("stop"), s["start"].alias("start"), F.lit(False).alias("own"))))))
    left = F.aggregate(back, _empty(F.lit(2**31 - 1)), lambda a, s: F.when(s["own"] & (s["stop"] <= a["at"]), _push(a, F.struct(s["start"].alias("start"), s["stop"].alias("stop")), a["at"])).otherwise(
        F.struct(F.when(s["own"], a["at"]).otherwise(F.least(a["at"], s["start"])).alias("at"), a["block"].alias("block"), a["full"].alias("full"))), _all_of)
    return F.reverse(left)


def candidates(text: Column, kind: str, base: Column) -> Column:
    """Spans of the kind's generator that share nothing with base spans, with features."""
    found = apart(located(text, WIDE[kind], lambda m: F.lit(True), NEEDS[kind]), base)
    return F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), features(text, c, kind).alias("x")))


FEATURES = ("chars", "digits", "letters", "groups", "spaces", "dots", "dashes", "plus", "paren", "at", "sum_ok", "octets_ok", "cue", "joined_before", "joined_after")


def features(text: Column, span: Column, kind: str) -> Column:
    """Format and context of a span as numbers, in the order of FEATURES."""
    m = F.substring(text, span["start"] + 1, span["stop"] - span["start"])
    before = F.substring(text, F.greatest(span["start"] + 1 - CONTEXT, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    after = F.substring(text, span["stop"] + 1, F.lit(1))

    def count(pattern: str) -> Column:
        return F.length(m) - F.length(F.regexp_replace(m, pattern, ""))

    number = digits(m)
    values = [
        F.length(m), F.length(number), count("[A-Za-z]"), F.size(F.split(m, "[^A-Za-z0-9]+")), count("\x20"), count("[.]"), count("-"),
        m.startswith("+"), m.contains("("), m.contains("@"),
        F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False),
        ~F.exists(F.split(m, "[^0-9]+"), lambda g: F.length(g) > 3) & ~F.exists(F.split(m, "[^0-9]+"), lambda g: F.coalesce(g.try_cast("int"), F.lit(0)) > 255),
        before.rlike(CUES), before.rlike("[A-Za-z0-9_]$"), after.rlike("^[A-Za-z0-9_]"),
    ]
    return F.array(*[v.cast("double") for v in values])


def boost(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Trees of depth two for the logistic loss: (feature, cut, (feature, cut, low, high) twice) each, leaves as Newton
    steps. The first element of the list is the starting log odds."""
    rate = (y.sum() + 1) / (len(y) + 2)
    trees: list = [float(np.log(rate / (1 - rate)))]
    score = np.full(len(y), trees[0])

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        best = (0.0, 0, np.inf)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= LEAST_LEAF) & (len(order) - at - 1 >= LEAST_LEAF)]
            if len(at):
                gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
        return best[1:]

    def leaf(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> float:
        return float(RATE * g[rows].sum() / (h[rows].sum() + 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h, rows = y - p, p * (1 - p), np.arange(len(y))
        f, cut = split(rows, g, h)
        sides = []
        for side in (rows[x[:, f] <= cut], rows[x[:, f] > cut]):
            f2, cut2 = split(side, g, h) if len(side) else (0, np.inf)
            low, high = side[x[side, f2] <= cut2], side[x[side, f2] > cut2]
            sides.append((f2, cut2, leaf(low, g, h) if len(low) else 0.0, leaf(high, g, h) if len(high) else 0.0))
            score[low] += sides[-1][2]
            score[high] += sides[-1][3]
        trees.append((f, cut, *sides))
    return trees


def tree_score(trees: list, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), trees[0])
    for f, cut, *sides in trees[1:]:
        for side, rows in zip(sides, (x[:, f] <= cut, x[:, f] > cut), strict=True):
            out[rows] += np.where(x[rows, side[0]] <= side[1], side[2], side[3])
    return out


def tree_expression(trees: list, x: Column) -> Column:
    """The trees as one expression over the feature array."""

    def at(f: int, cut: float) -> Column:
        return F.element_at(x, f + 1) <= F.lit(cut)

    def side(s: tuple) -> Column:
        return F.when(at(s[0], s[1]), F.lit(s[2])).otherwise(F.lit(s[3]))

    return reduce(lambda a, t: a + F.when(at(t[0], t[1]), side(t[2])).otherwise(side(t[3])), trees[1:], F.lit(trees[0]))


def widened(kind: str, m: Column) -> list[Column]:
    """The base span m in forms that only the generators know: known personal data, and so positive examples."""
    number = digits(m)
    return {
        "email": [F.regexp_replace(F.regexp_replace(m, r"\.(?=[^@]*$)", " [dot] "), "@", " [at] "), F.regexp_replace(m, "@", "(at)"), F.regexp_replace(m, "@", " @ ")],
        "ip": [F.regexp_replace(m, "[.]", " . "), F.regexp_replace(m, "[.]", ". ")],
        "card": [F.regexp_replace(number, "(.{4})(?=.)", "$1."), number],
        "phone": [F.regexp_replace(m, "^[+]", "00"), F.regexp_replace(m, r"^[+][0-9]+[\x20.-]+", ""), F.concat(F.substring(number, -10, 3), F.lit("-"), F.substring(number, -7, 3), F.lit("-"), F.substring(number, -4, 4))],
    }[kind]


def spoilt(kind: str, m: Column) -> list[Column]:
    """m changed so that it is no personal data of its kind: octets too great or too many, checksums that fail, dates."""
    number = digits(m)
    wrong = F.concat(F.substring(number, F.lit(1), F.length(number) - 1), ((F.substring(number, -1, 1).cast("int") + 1) % 10).cast("string"))
    return {
        "email": [],
        "ip": [F.concat(F.lit("9"), F.lpad(F.split(m, "[.]")[0], 3, "9"), F.lit("."), F.split(m, "[.]")[1], F.lit("."), F.split(m, "[.]")[2], F.lit("."), F.split(m, "[.]")[3]), F.concat(m, F.lit(".1.2"))],
        "card": [wrong, F.regexp_replace(wrong, "(.{4})(?=.)", "$1.")],
        "phone": [F.concat(F.substring(number, 1, 4), F.lit("-"), F.substring(number, 5, 2), F.lit("-"), F.substring(number, 7, 2)), F.concat(F.substring(number, 1, 2), F.lit("/"), F.substring(number, 3, 2), F.lit("/"), F.substring(number, 5, 4))],
    }[kind]


def examples(rows: DataFrame, kind: str) -> DataFrame:
    """x, y of the kind: base spans in wider forms between their neighbours (1); the same spoilt, or inside a longer word, and
    what the generator proposes beside base spans (0)."""
    text, base = F.col("text"), F.col("base")
    before = lambda s: F.substring(text, F.greatest(s["start"] + 1 - CONTEXT, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
    spans = rows.select("text", "doc_id", F.explode("base").alias("s"))
    spans = spans.select("doc_id", F.col("s.start").alias("start"), before(F.col("s")).alias("before"), F.substring(text, F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias("m"), F.substring(text, F.col("s.stop") + 1, F.lit(1)).alias("after"))
    forms = [(F.col("before"), w, F.col("after"), 1.0) for w in widened(kind, F.col("m"))]
    forms += [(F.col("before"), w, F.col("after"), 0.0) for w in spoilt(kind, F.col("m"))]
    forms += [(F.concat("before", F.lit("x")), w, F.lit("0b"), 0.0) for w in widened(kind, F.col("m"))]
    made = F.array(*[F.struct(F.concat(b, w, a).alias("text"), F.length(b).alias("start"), (F.length(b) + F.length(w)).alias("stop"), F.lit(y).alias("y")) for b, w, a, y in forms])
    made = spans.select("doc_id", "start", F.posexplode(made).alias("form", "e")).select("doc_id", "start", "form", F.col("e.text").alias("text"), F.struct("e.start", "e.stop").alias("c"), F.col("e.y").alias("y"))
    made = made.select("doc_id", "start", "form", features(text, F.col("c"), kind).alias("x"), "y")
    other = rows.select("doc_id", "text", F.explode(candidates(text, kind, base)).alias("c")).select("doc_id", F.col("c.start").alias("start"), F.lit(-1).alias("form"), F.col("c.x").alias("x"), F.lit(0.0).alias("y"))
    return made.unionByName(other)


def _with_added(own: Column, covered: Column, kind: str, model: tuple[list, float]) -> Column:
    trees, cut = model
    added = F.filter(candidates(F.col("text"), kind, covered), lambda c: tree_expression(trees, c["x"]) >= F.lit(cut))
    return F.array_sort(F.concat(own, F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop")))))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def train(rows: DataFrame) -> dict[str, tuple[list, float]]:
    """For each kind, trees and a threshold, from the examples of a bounded sample of texts, drawn by hash. A third of the
    examples calibrates the threshold: the least score above which PRECISION of them are positive."""
    sample = hash_sample(rows, SAMPLE_TEXTS, "doc_id")
    out = {}
    for kind in KINDS:
        every = sample.filter(F.col("text").rlike(NEEDS[kind])).withColumn("base", base_spans(F.col("text"), kind))
        every = written(examples(every, kind), "pii-examples")
        found = hash_sample(every, SAMPLE_CANDIDATES, "doc_id", "start", "form").collect()  # about SAMPLE_CANDIDATES rows
        discard(every)
        found.sort(key=lambda r: (r.doc_id is None, str(r.doc_id), r.start, r.form, r.x))  # training does not depend on partitions
        x, y = np.array([r.x for r in found], float), np.array([r.y for r in found], float)
        trial = np.array([zlib.crc32(f"{r.doc_id}:{r.start}".encode()) % 3 == 0 for r in found], bool)
        if len(y) < 60 or not 0 < y[~trial].sum() < (~trial).sum() or not 0 < y[trial].sum() < trial.sum():
            continue  # the corpus has no base spans of this kind to learn from
        trees = boost(x[~trial], y[~trial])
        s = tree_score(trees, x[trial])
        order = np.argsort(-s, kind="stable")
        precise = np.cumsum(y[trial][order]) / np.arange(1, trial.sum() + 1)
        # Of equal scores all pass or none: only the last of them counts.
        good = np.flatnonzero((precise >= PRECISION) & (np.diff(s[order], append=-np.inf) < 0))
        if len(good):
            out[kind] = (trees, float(s[order][good[-1]]))
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", models: dict | None = None) -> DataFrame:
    """doc_id, base and spans, one row for each row of docs: arrays of (kind, start, stop), by kind, then start.

    Offsets count code points, stop exclusive. base holds the matches of the fixed formats that pass their checks; spans
    also those that the trees add, which share no characters with base spans. Null texts count as empty and have
    no spans; rows repeated in full are judged alike; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    models = train(rows) if models is None else models
    rows = rows.withColumns({kind: base_spans(F.col("text"), kind) for kind in KINDS})
    covered = F.concat(*[F.col(k) for k in KINDS])
    every = [_with_added(F.col(k), covered, k, models[k]) if k in models else F.col(k) for k in KINDS]
    base = F.concat(*[_named(F.col(k), k) for k in KINDS])
    return rows.select("doc_id", base.alias("base"), F.concat(*[_named(x, k) for k, x in zip(KINDS, every, strict=True)]).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets, last first, so that offsets stay right."""
    by_start = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["stop"], s["kind"]))))

    def step(t: Column, s: Column) -> Column:
        return F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("["), s["kind"], F.lit("]"), F.substring(t, s["stop"] + 1, F.length(t)))

    return F.aggregate(by_start, text, step)
