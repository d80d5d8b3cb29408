"""Sliding-window rate limiting, as a batch operator and as a stream with keyed state.

Only accepted hits count, so each decision depends on those before it: state per key is the accepted times of the window.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S = 60.0


def decide(times: list[float], hits: deque, per_window: int, window: float) -> list[int | None]:
    """None for accepted hits, else the seconds to wait. `hits` holds accepted times and is changed."""
    out: list[int | None] = []
    for t in times:
        while hits and t - hits[0] > window:
            hits.popleft()
        if per_window > 0 and len(hits) >= per_window:
            out.append(max(1, math.ceil(window - (t - hits[0]))))
        else:
            hits.append(t)
            out.append(None)
    return out


def limit_rate(df: DataFrame, key: str, ts: str, ident: str, per_window: int, window: float = WINDOW_S) -> DataFrame:
    """ident, retry_after (null: accepted) for every hit. Keys are spread over tasks; a task holds one batch and the window of
    the current key, so a key with a third of all hits streams through one task in sorted order."""
    sec = F.col(ts).cast("timestamp").cast("double")
    rows = df.select(F.col(key).alias("k"), sec.alias("t"), F.col(ident).alias("i")).repartition("k").sortWithinPartitions("k", "t", "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, hits = None, deque()
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                if k != last:
                    last, hits = k, deque()
                out += decide([t], hits, per_window, window)
            yield pd.DataFrame({ident: b["i"], "retry_after": pd.array(out, dtype="Int64")})

    return rows.mapInPandas(run, f"{ident} bigint, retry_after bigint")


def arrivals_in_window(df: DataFrame, key: str, ts: str, window: int) -> DataFrame:
    """Adds the hits of the key in the window seconds up to each hit: the limiter's upper bound, all in the JVM."""
    sec = F.col(ts).cast("timestamp").cast("bigint")
    w = Window.partitionBy(key).orderBy(sec).rangeBetween(-window, 0)
    return df.withColumn("arrivals", F.count("*").over(w))


def limit_stream(stream: DataFrame, key: str, ts: str, ident: str, per_window: int, window: float = WINDOW_S, watermark: str = "2 minutes") -> DataFrame:
    """The same on a stream: accepted times are keyed state that goes when a key has been idle for a window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["t", "i"])
        out = decide(rows["t"].tolist(), hits, per_window, window)
        state.update((list(hits),))
        if state.getCurrentWatermarkMs() >= 0 and hits:
            state.setTimeoutTimestamp(max(int((hits[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": str(k[0]), ident: rows["i"], "retry_after": pd.array(out, dtype="Int64")})

    timed = stream.select(F.col(key).cast("string").alias("k"), F.col(ts).alias("at"), F.col(ts).cast("double").alias("t"), F.col(ident).alias("i"))
    rows = timed.withWatermark("at", watermark)
    return rows.groupBy("k").applyInPandasWithState(step, f"k string, {ident} bigint, retry_after bigint", "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)
