"""Sensitive-data detection: validators, the scan with its filters, masking and decisions.

Checksums are native expressions. The scan needs offsets, context and claims between groups, so it runs as an Arrow
batch function, behind a native pre-filter that keeps texts without any cheap sign of a match in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.dlp_catalog import BUILTIN, Group

#: Characters of context on each side, and sizes of encoded blobs.
CONTEXT, BLOB, BLOB_EXTRA = 30, 48, 12


# --- validators, native ---------------------------------------------------------------------------------------------


def bare(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9]", "")


def digits(value: Column) -> Column:
    """The digits of a value as an array of ints."""
    return F.transform(F.filter(F.split(bare(value), ""), lambda c: c.rlike("^[0-9]$")), lambda c: c.cast("int"))


def luhn(value: Column) -> Column:
    """13 digits or more, not all the same, and the Luhn sum divides by ten."""
    d = F.reverse(digits(value))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return (F.size(d) >= 13) & (F.size(F.array_distinct(d)) > 1) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)


def iban(value: Column) -> Column:
    """15 to 34 characters whose rearranged number leaves 1 when divided by 97."""
    v = F.upper(bare(value))
    turned = F.filter(F.split(F.concat(F.substring(v, F.lit(5), F.length(v)), F.left(v, F.lit(4))), ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.length(v).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)


def uk_nino(value: Column) -> Column:
    v = F.upper(bare(value))
    return v.rlike("^(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z]{2}[0-9]{6}[A-D]$") & ~v.rlike("^..000000")


def _dihedral(a: int, b: int) -> int:
    """The product in the dihedral group of ten elements, which Verhoeff's scheme computes in."""
    if a < 5:
        return (a + b) % 5 if b < 5 else (a + b) % 5 + 5
    return (a - b) % 5 + 5 if b < 5 else (a - b) % 5


@lru_cache(maxsize=1)
def _verhoeff_tables() -> tuple[list[list[int]], list[list[int]]]:
    product = [[_dihedral(a, b) for b in range(10)] for a in range(10)]
    once = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed value: the permutation that is applied again for each place
    turns = [list(range(10))]
    for _ in range(7):
        turns.append([once[x] for x in turns[-1]])
    return product, turns


def verhoeff(value: Column) -> Column:
    """12 digits, not all the same nor ascending, with a Verhoeff check of 0."""
    product, turns = _verhoeff_tables()
    table = F.array(*[F.lit(x) for row in product for x in row])
    places = F.array(*[F.lit(x) for row in turns for x in row])
    d = digits(value)
    numbered = F.transform(F.reverse(d), lambda x, i: F.element_at(places, (i % 8) * 10 + x + 1))
    check = F.aggregate(numbered, F.lit(0), lambda a, x: F.element_at(table, a * 10 + x + 1))
    ascending = F.forall(F.transform(d, lambda x, i: (x - F.element_at(d, 1) - i) % 10 == 0), lambda x: x)
    return (F.size(d) == 12) & (F.size(F.array_distinct(d)) > 1) & ~ascending & (check == 0)


def unique_chars(value: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))


VALIDATORS = {"luhn": luhn, "iban": iban, "uk_nino": uk_nino, "verhoeff": verhoeff}


# --- validators, for the scan ---------------------------------------------------------------------------------------


def _luhn(v: str) -> bool:
    d = [int(c) for c in v if "0" <= c <= "9"]
    total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
    return len(d) >= 13 and len(set(d)) > 1 and total % 10 == 0


def _iban(v: str) -> bool:
    v = re.sub("[^A-Za-z0-9]", "", v).upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _uk_nino(v: str) -> bool:
    v = re.sub("[^A-Za-z0-9]", "", v).upper()
    return bool(re.fullmatch("(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z]{2}(?!000000)[0-9]{6}[A-D]", v))


def _verhoeff(v: str) -> bool:
    product, turns = _verhoeff_tables()
    d, check = [int(c) for c in v if "0" <= c <= "9"], 0
    for i, x in enumerate(reversed(d)):
        check = product[check][turns[i % 8][x]]
    return len(d) == 12 and len(set(d)) > 1 and any(x != (d[0] + i) % 10 for i, x in enumerate(d)) and check == 0


_PLAIN = {"luhn": _luhn, "iban": _iban, "uk_nino": _uk_nino, "verhoeff": _verhoeff}


# --- the scan -------------------------------------------------------------------------------------------------------


def compiled(group: Group) -> tuple[list[re.Pattern], list[re.Pattern]] | None:
    """Positive and negative expressions; None if one of them is no valid expression, which leaves the group out."""

    def one(pattern: str, keyword: bool) -> re.Pattern:
        return re.compile(re.escape(pattern), re.IGNORECASE) if keyword else re.compile(pattern)

    try:
        positive = [one(p, group.keywords) for p in group.patterns if p.strip()]
        return positive, [one(p, group.negatives_are_keywords) for p in group.negatives if p.strip()]
    except re.error:
        return None


_BLOB_CHARS = re.compile(r"[A-Za-z0-9+/=_%\-]*")


def in_blob(text: str, start: int, stop: int) -> bool:
    """True if the match is a small part of a long run that looks hex, URL- or base64-encoded."""
    left = start
    while left and _BLOB_CHARS.fullmatch(text[left - 1]):
        left -= 1
    right = _BLOB_CHARS.match(text, stop).end()
    blob = text[left:right]
    size = len(blob.encode())
    if size < BLOB or (start - left) + (right - stop) < BLOB_EXTRA:
        return False
    if size >= 64 and re.fullmatch("[0-9A-Fa-f]+", blob):
        return True
    triplets = len(re.findall("%[0-9A-Fa-f]{2}", blob))
    if triplets >= 8 and triplets * 3 >= size // 3:
        return True
    if not re.fullmatch(r"[A-Za-z0-9+/=_\-]+", blob):
        return False
    return bool((re.search(r"[+/=_\-]", blob) or size % 4 == 0) and re.search("[A-Z]", blob) and re.search("[a-z]", blob) and re.search("[0-9]", blob))


def matches(text: str, group: Group, seen: set[str] = frozenset()) -> list[tuple[str, int]]:
    """(value, offset) of the matches of one group that pass its filters, repeats included."""
    found, ready = [], compiled(group)
    for pattern in ready[0] if ready else ():
        for m in pattern.finditer(text):
            value = m.group()
            near = text[max(0, m.start() - CONTEXT) : m.end() + CONTEXT]
            if value in seen or any(n.search(near) for n in ready[1]) or in_blob(text, m.start(), m.end()):
                continue
            if len(set(value)) < group.min_unique_chars or (group.validator and not _PLAIN[group.validator](value)):
                continue
            found.append((value, m.start()))
    return found


def detections(text: str, groups=BUILTIN, line_offset: int = 0) -> list[dict]:
    """What is found in a text. A value that an earlier group reported is skipped by later ones; repeats within a group
    count towards its minimum. Lines count from 1, columns are bytes from 1."""
    out, seen = [], set()
    for group in groups:
        found = matches(text, group, seen)
        if len(found) < group.min_occurrences:
            continue
        for value, at in found:
            seen.add(value)
            begin = text.rfind("\n", 0, at) + 1
            out.append({"name": group.name, "value": value, "line": text.count("\n", 0, at) + 1 + line_offset, "col": len(text[begin:at].encode()) + 1})
    return out


def tested(text: str, group: Group) -> list[str]:
    """The pattern tester: no validator, and the minimum counts different values."""
    values = list(dict.fromkeys(v for v, _ in matches(text, group._replace(validator=None))))
    return values if len(values) >= group.min_occurrences else []


DETECTION = "array<struct<name:string,value:string,line:int,col:int>>"


def scan(rows: DataFrame, text: str, groups=BUILTIN, signs: str | None = None) -> DataFrame:
    """rows with `detections`. signs: a pattern without which a text cannot match; such texts never leave the JVM's side with their
    content. The built-in catalogue has none: some of its values are letters only."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([detections(t, groups) if t else [] for t in texts], dtype=object)

    finder = F.pandas_udf(run, DETECTION)
    content = F.col(text) if signs is None else F.when(F.col(text).rlike(signs), F.col(text))
    return rows.withColumn("detections", finder(content))


# --- decisions and masks --------------------------------------------------------------------------------------------


def estimated_tokens(text: Column) -> Column:
    """floor(words * 1.5), words between any white space."""
    bare_text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    words = F.when(bare_text == "", 0).otherwise(F.size(F.split(bare_text, " ")))
    return F.floor(words * 1.5)


def decision(text: Column, found: Column, max_tokens: int) -> Column:
    """status and action: too many tokens first (429, 3), then anything found (403, 2), else 200 and 0."""
    over = (F.lit(max_tokens) > 0) & (estimated_tokens(text) > max_tokens)
    return F.when(over, F.struct(F.lit(429).alias("status"), F.lit(3).alias("action"))).when(found, F.struct(F.lit(403).alias("status"), F.lit(2).alias("action"))).otherwise(F.struct(F.lit(200).alias("status"), F.lit(0).alias("action")))


#: Parts of a variable's name that mark its value as secret.
SENSITIVE_NAMES = ("KEY", "SECRET", "TOKEN", "PASSWORD", "PASSWD", "CREDENTIALS", "AUTH", "API_KEY", "PRIVATE", "CERT")


def masked(name: Column, value: Column) -> Column:
    """*** for secrets; the first 40 characters of values over 80 bytes."""
    secret = F.upper(name).rlike("|".join(SENSITIVE_NAMES))
    return F.when(secret, F.lit("***")).when(F.octet_length(value) > 80, F.concat(F.left(value, F.lit(40)), F.lit("..."))).otherwise(value)


#: Words in a pattern's name that make a detection a secret; all others are personal data.
SECRET_NAMES = ("api", "key", "token", "secret", "credential", "password", "aws", "database", "webhook", "jwt", "private key", "slack", "stripe", "sendgrid", "twilio", "github", "discord")


def category(name: Column) -> Column:
    return F.when(F.lower(name).rlike("|".join(SECRET_NAMES)), F.lit("secrets")).otherwise(F.lit("pii"))
