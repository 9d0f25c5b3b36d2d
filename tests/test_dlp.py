"""Validators, the scan and its filters on literal cases."""

import pytest
from pyspark.sql import functions as F

from trailmark.operators import dlp
from trailmark.operators.dlp_catalog import BUILTIN, Group

CASES = {
    "luhn": [("4532015112830366", True), ("5425233430109903", True), ("4532-0151-1283-0366", True), ("4532015112830367", False), ("4444444444444444", False), ("0", False), ("", False)],
    "verhoeff": [("276598387210", True), ("498123456788", True), ("123456789012", False), ("585293751385", False), ("27659838721", False), ("222222222222", False)],
    "iban": [("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 31", False), ("DE75512108001245126199", True), ("DE7551210800", False)],
    "uk_nino": [("AB 12 34 56 C", True), ("BG 12 34 56 A", False), ("AB 00 00 00 A", False), ("AB123456E", False)],
}


@pytest.mark.parametrize("name", CASES)
def test_validators_native_and_plain_agree(spark, name):
    df = spark.createDataFrame(CASES[name], "v string, ok boolean")
    got = df.select("v", "ok", F.coalesce(dlp.VALIDATORS[name](F.col("v")), F.lit(False)).alias("native")).collect()
    assert all(r.ok == r.native == dlp._PLAIN[name](r.v) for r in got)


def test_catalogue_compiles():
    assert len(BUILTIN) == 18 and sum(len(g.patterns) for g in BUILTIN) == 68
    assert all(dlp.compiled(g) for g in BUILTIN)


def found(text, groups=BUILTIN):
    return [(d["name"], d["value"], d["line"], d["col"]) for d in dlp.detections(text, groups)]


def test_detections():
    key = "AKIA" + "Q3ZK7WLM2XNB4VTY"
    assert found(f"a\né {key}") == [("API Keys", key, 2, 4)]
    assert found(f"example {key}") == [] and found("postgres://user:s3cretPassw0rd@db.internal/app")[0][0] == "Database Credentials"
    card = "4532015112830366"
    assert found(f"card {card} and {card}") == [("Credit/Debit Card Number", card, 1, 6), ("Credit/Debit Card Number", card, 1, 27)]


def test_negative_words_drop_only_near_matches():
    group = Group("k", (r"key-\d+",), ("dummy",), negatives_are_keywords=True)
    text = "dummy key-1" + "." * 40 + "key-2"
    assert [v for v, _ in dlp.matches(text, group)] == ["key-2"]


def test_encoded_blobs_hide_matches():
    group = Group("k", ("AKIA[A-Z0-9]{4}",))
    blob = "aB3" * 15 + "AKIAAAAA" + "xY9+" * 10
    assert dlp.matches(blob, group) == [] and len(dlp.matches(f"id AKIAAAAA end {blob[:10]}", group)) == 1


def test_minimum_counts_repeats_in_scan_and_values_in_tester():
    group = Group("k", (r"id\d",), min_occurrences=2)
    assert len(found("id1 id1", (group,))) == 2 and dlp.tested("id1 id1", group) == [] and dlp.tested("id1 id2", group) == ["id1", "id2"]


def test_earlier_groups_claim_values_and_broken_groups_are_left_out():
    groups = (Group("broken", ("(",)), Group("a", (r"\d{4}",)), Group("b", (r"\d{4}", "x")))
    assert [x[:2] for x in found("1234 x", groups)] == [("a", "1234"), ("b", "x")]


def test_scan_and_decisions(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ssn 212-45-1234"), (4, "plain words")], "id long, text string")
    got = {r.id: [d.value for d in r.detections] for r in dlp.scan(rows, "text").collect()}
    assert got == {1: [], 2: [], 3: ["212-45-1234"], 4: []}
    d = rows.select("id", dlp.decision(F.coalesce("text", F.lit("")), F.col("id") == 3, 2).alias("d")).collect()
    assert {r.id: (r.d.status, r.d.action) for r in d} == {1: (200, 0), 2: (200, 0), 3: (429, 3), 4: (429, 3)}
