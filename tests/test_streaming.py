"""The stateful log: rules one by one, and stream against batch."""

import datetime as dt
import json

from pyspark.sql import functions as F

from trailmark.streaming import upsert

START = dt.datetime(2024, 1, 1)


def event(seq, minute, kind, correlation="c", session="s", **more):
    base = {"seq": seq, "ts": START + dt.timedelta(minutes=minute), "backend": "b", "session_id": session, "correlation_id": correlation, "endpoint_name": "P", "kind": kind, "tokens": 1, "cache_tokens": 0, "status": 200, "action": 0, "model": None, "response": None, "meta": None}
    return base | more


def run(spark, events):
    df = spark.createDataFrame([tuple(e.values()) for e in events], upsert.EVENT)
    return {r.id: r for r in upsert.batch(df).collect()}


def test_requests_within_five_minutes_fold(spark):
    got = run(spark, [event(1, 0, "request"), event(2, 4, "request", status=500, action=2, tokens=10), event(3, 6, "request"), event(4, 6, "request", correlation=None)])
    assert set(got) == {1, 3, 4} and (got[1].input_tokens, got[1].status, got[1].dlp_action) == (11, 500, 2)


def test_outputs_add_or_overwrite(spark):
    got = run(spark, [event(1, 0, "request"), event(2, 1, "output", tokens=5), event(3, 2, "usage", tokens=7, cache_tokens=3, model="m"), event(4, 40, "output", tokens=99)])
    assert (got[1].output_tokens, got[1].cache_read_tokens, got[1].assistant, got[1].model, got[1].latency_ms) == (7, 3, 1, "m", 120_000)
    got = run(spark, [event(1, 0, "request"), event(2, 1, "output", tokens=5)])
    assert (got[1].output_tokens, got[1].assistant) == (5, 0)


def test_close_takes_the_newest_open_row(spark):
    got = run(spark, [event(1, 0, "request"), event(2, 10, "request", correlation="d"), event(3, 11, "close_usage", correlation=None, tokens=4), event(4, 12, "close_add", correlation=None, tokens=6)])
    assert (got[2].output_tokens, got[2].assistant, got[1].output_tokens, got[1].assistant) == (4, 1, 6, 1)


def test_thinking_and_saving(spark):
    got = run(spark, [event(1, 0, "request"), event(2, 4, "thinking", tokens=3), event(3, 6, "thinking", tokens=3), event(4, 29, "saving", tokens=8, meta="{}"), event(5, 0, "request", session="t")])
    assert (got[1].output_tokens, got[1].has_thinking, got[1].tokens_saved, got[1].meta) == (3, 1, 8, "{}") and got[5].tokens_saved == 0


def test_stream_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(1)
    kinds = ["request", "output", "usage", "close_usage", "close_add", "saving", "thinking"]
    events = [event(i, i * 0.7, rng.choice(kinds), correlation=f"c{rng.randrange(6)}", session=f"s{rng.randrange(3)}", tokens=rng.randrange(9)) for i in range(150)]
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for part in range(3):  # three micro-batches in order of time
        with open(source / f"{part}.json", "w") as f:
            for e in events[part * 50 : part * 50 + 50]:
                f.write(json.dumps(e | {"ts": e["ts"].isoformat()}) + "\n")
            f.write("not json\n")
        query = upsert.write_upserts(upsert.stream(upsert.hook_source(spark, str(source))), str(target), str(tmp_path / "ck"))
        query.awaitTermination(120)
        assert query.exception() is None
    rows = spark.read.parquet(str(target)).groupBy("id").agg(F.max_by(F.struct(*upsert.COLUMNS), "version").alias("r")).select("r.*")
    want = run(spark, events)
    got = {r.id: r for r in rows.collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i].asDict() == want[i].asDict()


def test_late_events_are_not_dropped(spark, tmp_path):
    events = [event(1, 0, "request", correlation="a"), event(2, 600, "request", correlation="b"), event(3, 10, "request", correlation="c")]
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for part, e in enumerate(events):
        (source / f"{part}.json").write_text(json.dumps(e | {"ts": e["ts"].isoformat()}) + "\n")
        query = upsert.write_upserts(upsert.stream(upsert.hook_source(spark, str(source))), str(target), str(tmp_path / "ck"))
        query.awaitTermination(120)
        assert query.exception() is None
    assert {r.id for r in spark.read.parquet(str(target)).collect()} == set(run(spark, events)) == {1, 2, 3}
