"""Event streams: sessions of close events, the latest state of each key, and counts in windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """key, started, ended, n: events of a key that follow each other within ``gap``; batch or stream.

    On a stream, a session is given out once the watermark, ``late`` behind the newest event, has passed it.
    """
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    s = events.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def window_counts(events: DataFrame, key: str, ts: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """key, started, n in tumbling or sliding windows; batch or stream."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")


def latest(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """key, ts, value of the last event of each key in a batch; ties by the greater value."""
    return events.groupBy(key).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(value).alias("value"))).alias("m")).select(key, "m.ts", "m.value")


def latest_changes(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """A stream of key, ts, value: given out only when a key's latest value becomes another.

    Late events are older than the state and change nothing.
    """
    out, state = f"{key} bigint, ts timestamp, value string", "ts timestamp, value string"

    def step(k: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last_ts, last_value = held.get if held.exists else (None, None)
        before = last_value
        for pdf in frames:
            for t, v in pdf.sort_values(["ts", "value"])[["ts", "value"]].itertuples(index=False):
                if last_ts is None or t.to_pydatetime() >= last_ts:
                    last_ts, last_value = t.to_pydatetime(), v
        held.update((last_ts, last_value))
        if last_value != before:
            yield pd.DataFrame({key: [k[0]], "ts": [pd.Timestamp(last_ts)], "value": [last_value]})

    slim = events.select(F.col(key).cast("bigint"), F.col(ts).alias("ts"), F.col(value).cast("string").alias("value"))
    return slim.groupBy(key).applyInPandasWithState(step, out, state, "append", "NoTimeout")
