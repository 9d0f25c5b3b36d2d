"""The pipeline's stages against brute force, and whole runs."""

from collections import Counter

from tests.llm.test_operators import brute_classes, docs, prose, toxic_rows, words


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = toxic_rows(150)
    toxic = {r[0] for r in rows if r[3]}
    base = prose(4242, 120)
    texts = [r[:3] for r in rows] + [(500, base, "t"), (501, base, "t"), (502, base + " more", "t"), (503, None, None), (504, "", None)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    assert 4 <= len(pipeline.STAGES) <= 5
    for number, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r.text for r in now.collect()}
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        now = spark.read.parquet(f"{tmp_path}/{number}")
        if name != "packing":
            assert now.columns == columns
            after = {r.doc_id: r.text for r in now.collect()}
        if name == "toxicity":
            assert len(toxic - set(after)) >= 0.9 * len(toxic) and len(set(before) - set(after) - toxic) <= 2
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i] or "", i)
            assert set(after) == set(first.values())
        elif name == "near_dedup":
            assert set(after) == set(brute_classes(before).values())
        elif name == "mixing":
            had, has = (sum(len(words(t)) for t in x.values()) for x in (before, after))
            assert abs(has - had) <= 0.05 * had
            for i, t in after.items():
                most = Counter(words(before[i]))
                assert all(k <= 3 * most[w] for w, k in Counter(words(t)).items())
        else:
            pieces = now.collect()
            assert {r.doc_id for r in pieces} == set(before)
            assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    assert pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_dedup_stages_judge_rows_not_keys(spark):
    """Rows without a key, or of one key, keep their own texts; copies go row by row."""
    from trailmark.llm import exact_dedup, near_dedup

    a, b, c, d, e = (prose(9100 + i, 60) for i in range(5))
    rows = [(1, a, "s"), (None, a, "s"), (None, b, "s"), (None, b, "s"), (None, c, "s"), (2, d, "s"), (7, d, "s"), (7, e, "s"), (7, e, "s"), (8, None, "s"), (7, "", "s")]
    rows += [(9, d + " more", "s"), (None, e + " more", "s")]
    kept = exact_dedup.kept_rows(docs(spark, rows))
    exact = {(1, a), (None, b), (None, c), (2, d), (7, e), (7, ""), (9, d + " more"), (None, e + " more")}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs(spark, []).columns and set(got) == exact and len(got) == len(exact)
    got = [(r.doc_id, r.text) for r in near_dedup.kept_rows(docs(spark, rows)).collect()]
    near = exact - {(9, d + " more"), (None, e + " more")}
    assert set(got) == near and len(got) == len(near)


def test_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= names
