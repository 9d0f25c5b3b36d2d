"""The request log as keyed state: hook events update the rows of their session.

One event either adds a row or changes earlier ones, by rules that look back 5 or 30 minutes on event time. State is kept
for each (backend, session); rows older than the longest look-back leave it. Late events are not dropped by rule: a
request adds a row, an update that finds none does nothing. `fold` is the rule set on plain rows; batch and stream
run the same code.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Look-back in seconds.
SHORT, LONG = 5 * 60, 30 * 60

EVENT = "seq long, ts timestamp, backend string, session_id string, correlation_id string, endpoint_name string, kind string, tokens long, cache_tokens long, status int, action int, model string, response string, meta string"
ROW = "backend string, session_id string, correlation_id string, id long, ts timestamp, endpoint_name string, input_tokens long, output_tokens long, cache_read_tokens long, status int, dlp_action int, model string, response string, assistant int, latency_ms long, has_thinking int, tokens_saved long, meta string"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def _new(e: dict) -> dict:
    return {
        "backend": e["backend"], "session_id": e["session_id"], "correlation_id": e["correlation_id"], "id": e["seq"], "ts": e["ts"],
        "endpoint_name": e["endpoint_name"], "input_tokens": e["tokens"] or 0, "output_tokens": 0, "cache_read_tokens": 0, "status": e["status"] or 0,
        "dlp_action": e["action"] or 0, "model": e["model"], "response": None, "assistant": 0, "latency_ms": 0, "has_thinking": 0, "tokens_saved": 0, "meta": None,
    }


def fold(rows: list[dict], e: dict) -> list[dict]:
    """Applies one event to the rows of its session, oldest first; returns the rows that it added or changed."""

    def within(row: dict, seconds: int) -> bool:
        return e["ts"] - row["ts"] <= pd.Timedelta(seconds=seconds)

    def newest(seconds: int, **match: Any) -> dict | None:
        found = [r for r in rows if within(r, seconds) and all(r[k] == v for k, v in match.items())]
        return max(found, key=lambda r: r["id"]) if found else None

    own = {"correlation_id": e["correlation_id"]}
    opened = {"endpoint_name": e["endpoint_name"], "assistant": 0}
    kind = e["kind"]
    if kind == "request":
        row = newest(SHORT, **own) if e["correlation_id"] is not None else None
        if row is None:
            rows.append(row := _new(e))
        else:
            row["input_tokens"] += e["tokens"] or 0
            row["status"], row["dlp_action"] = max(row["status"], e["status"] or 0), max(row["dlp_action"], e["action"] or 0)
        return [row]
    if kind == "saving":
        found = [r for r in rows if within(r, LONG) and r["correlation_id"] == e["correlation_id"]]
        for r in found:
            r["tokens_saved"], r["meta"] = e["tokens"] or 0, e["meta"]
        return found
    if kind == "thinking":
        row = newest(SHORT, **own)
        if row:
            row["output_tokens"] += e["tokens"] or 0
            row["has_thinking"] = 1
        return [row] if row else []
    row = newest(LONG, **(opened if kind.startswith("close") else own))
    if row is None:
        return []
    if kind.endswith("usage"):
        row["output_tokens"], row["cache_read_tokens"] = e["tokens"] or 0, e["cache_tokens"] or 0
    else:
        row["output_tokens"] += e["tokens"] or 0
    if kind != "output" or e["response"] is not None:
        row["assistant"] = 1
        for k in ("model", "response"):
            row[k] = e[k] if e[k] is not None else row[k]
    row["latency_ms"] = max(0, int((e["ts"] - row["ts"]).total_seconds() * 1000))
    return [row]


def _events(frame: pd.DataFrame) -> Iterator[dict]:
    clean = frame.astype(object).where(frame.notna(), None)
    for e in clean.sort_values(["ts", "seq"], kind="stable").to_dict("records"):
        for k in ("tokens", "cache_tokens", "status", "action", "seq"):
            e[k] = None if e[k] is None else int(e[k])
        yield e


def batch(events: DataFrame) -> DataFrame:
    """The rows that a log of events leaves, each session in order of time, then sequence."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        done: list[dict] = []
        rows: list[dict] = []
        for e in _events(frame):
            fold(rows, e)
            gone = [r for r in rows if e["ts"] - r["ts"] > pd.Timedelta(seconds=LONG)]
            if len(gone) > 64:  # rows that no event can reach any more leave the search
                done += gone
                rows = [r for r in rows if e["ts"] - r["ts"] <= pd.Timedelta(seconds=LONG)]
        return pd.DataFrame(done + rows, columns=COLUMNS)

    return events.groupBy("backend", "session_id").applyInPandas(run, ROW)


def stream(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Added and changed rows of every micro-batch (update mode); the newest version of an id is the one that counts. Late events
    follow the rules like others up to `delay` behind the newest of all events; later ones are dropped. State of a session, its rows
    of the last 30 minutes, goes when the watermark, `delay` behind, passes its last row's look-back."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [r | {"ts": pd.Timestamp(r["ts"])} for r in json.loads(state.get[0])] if state.exists else []
        changed: dict[int, dict] = {}
        newest = None
        for e in _events(pd.concat(list(frames))):
            for r in fold(rows, e):
                changed[r["id"]] = r
            newest = e["ts"] if newest is None else max(newest, e["ts"])
        yield pd.DataFrame(list(changed.values()), columns=COLUMNS)
        rows = [r for r in rows if newest - r["ts"] <= pd.Timedelta(seconds=LONG)]
        if rows:
            state.update((json.dumps([r | {"ts": r["ts"].isoformat()} for r in rows]),))
            last = max(r["ts"] for r in rows) + pd.Timedelta(seconds=LONG)
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    keyed = events.withWatermark("ts", delay).groupBy("backend", "session_id")
    return keyed.applyInPandasWithState(run, ROW, "rows string", "update", GroupStateTimeout.EventTimeTimeout)


def hook_source(spark, path: str, schema: str = EVENT) -> DataFrame:
    """A folder of JSON lines as a stream of events; lines that do not parse become nulls and are left out."""
    raw = spark.readStream.text(path)
    return raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).select("e.*").filter("kind is not null and ts is not null")


def write_upserts(rows: DataFrame, path: str, checkpoint: str):
    """Writes each micro-batch's versions to path/batch=N; readers take the newest version of an id."""

    def write(frame: DataFrame, number: int) -> None:
        frame.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
