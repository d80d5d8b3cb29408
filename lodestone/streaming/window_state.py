"""Sliding-window rate limiting on a stream, with keyed state and event-time timers.

Hits wait in map state, in slots of event time, until the watermark has passed their slot; a timer at the slot's end then
decides its hits in order of time (ties by id) against the accepted times of the window, which are state too. So decisions do
not depend on how rows were dealt to micro-batches, and memory holds one slot of one lane and at most the accepted hits of a
window, however hot a key is: what waits is in the state store. A timer at the end of the last slot that the window after the
last accepted hit meets clears a lane that has been idle since; a lane that goes on drops such hits whenever it decides.

A lane is the state of one key, or with `lanes` that of all keys of a hash: a call to the state store costs milliseconds, a hit
microseconds, so the calls should grow with lanes and slots, not with keys. Hits are appended as chunks of Arrow rows, and a lane
has a timer for its first slot that waits only.

Hits behind the watermark are dropped, as always on streams. Hits behind no watermark yet stay in the state: a stream ends
with a mark (a row of any key, later than all by the watermark's delay and a slot), or goes on.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.schemas import struct
from lodestone.streaming.limiter import WINDOW_S, decide

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Built without a session: executors have none.
SLOT, ROWS = struct("slot bigint, part bigint"), struct("rows binary")
OUTPUT = "k string, id long, retry_after long, accepted_before int"
#: Rows of a lane that are taken in before they go to the state store.
CHUNK = 100_000


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


class WindowLimiter(StatefulProcessor):
    """Output: k, id, retry_after (null: accepted) and accepted_before (accepted hits in the window when the hit came)."""

    def __init__(self, per_window: int, window: float, slot: float):
        self.per_window, self.window, self.slot = per_window, window, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", SLOT, ROWS)
        self.accepted = handle.getValueState("accepted", ROWS)

    def end_of(self, slot: int) -> int:
        """The millisecond at which a slot is over."""
        return int(np.ceil((slot + 1) * self.slot * 1000))

    def idle_at(self, t: float) -> int:
        """The millisecond at which the last slot that the window after an accepted hit meets is over."""
        return self.end_of(int(np.floor((t + self.window) / self.slot)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts: dict[int, int] = defaultdict(int)
        for s, part in self.waiting.keys():
            parts[s] = max(parts[s], part + 1)
        held: list[pd.DataFrame] = []

        def store() -> None:
            taken = pd.concat(held)
            held.clear()
            for s, own in taken.groupby(np.floor(taken["t"].to_numpy() / self.slot).astype(np.int64)):
                self.waiting.updateValue((int(s), parts[int(s)]), (packed(own),))
                parts[int(s)] += 1

        for batch in rows:
            held.append(batch[["own", "t", "id"]])
            if sum(map(len, held)) >= CHUNK:
                store()
        if held:
            store()
        if parts:
            self.handle.registerTimer(self.end_of(min(parts)))
        yield from ()

    def decided(self, rows: pd.DataFrame, hits: dict[str, deque]) -> pd.DataFrame:
        """The rows of a slot in order, with their decisions; `hits` is changed."""
        rows = rows.sort_values(["own", "t", "id"])
        wait, before = [], []
        for k, t in zip(rows["own"].tolist(), rows["t"].tolist()):
            own = hits[k]
            wait += decide([t], own, self.per_window, self.window)
            before.append(len(own) - (wait[-1] is None))
        return pd.DataFrame({"k": rows["own"].to_numpy(), "id": rows["id"].to_numpy(), "retry_after": pd.array(wait, dtype="Int64"), "accepted_before": np.array(before, dtype=np.int32)})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The first timer of a lane decides all slots that are over, in order, whatever the order of the timers."""
        now = timerValues.getCurrentWatermarkInMs()
        slots: dict[int, list[int]] = defaultdict(list)
        for s, part in self.waiting.keys():
            slots[s].append(part)
        over = sorted(s for s in slots if self.end_of(s) <= now)
        if later := slots.keys() - set(over):
            self.handle.registerTimer(self.end_of(min(later)))
        hits: dict[str, deque] = defaultdict(deque)
        if self.accepted.exists():
            old = unpacked(self.accepted.get()[0])
            for k, t in zip(old["k"].tolist(), old["t"].tolist()):
                hits[k].append(t)
        for s in over:
            yield self.decided(pd.concat([unpacked(self.waiting.getValue((s, part))[0]) for part in slots[s]]), hits)
            for part in slots[s]:
                self.waiting.removeKey((s, part))
        # A hit that waits may be older than the watermark: accepted times go once the last slot that their window meets is decided.
        kept = [(k, t) for k, own in hits.items() for t in own if self.idle_at(t) > now]
        if kept:
            self.accepted.update((packed(pd.DataFrame(kept, columns=["k", "t"])),))
            self.handle.registerTimer(self.idle_at(max(t for _, t in kept)))
        elif self.accepted.exists():
            self.accepted.clear()

    def close(self) -> None:
        pass


def limit_with_state(stream: DataFrame, key: str, ts: str, ident: str, per_window: int, window: float = WINDOW_S, delay: str = "1 minute", slot: float = WINDOW_S, lanes: int | None = None) -> DataFrame:
    """k, id, retry_after, accepted_before for each hit of a stream; null keys are one key, rows without a time are dropped. Needs
    the RocksDB state store. `lanes`: the number of hashes by which keys share their state (default: each key has its own)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.col(ts).cast("timestamp")
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("own"), at.alias("at"), at.cast("double").alias("t"), F.col(ident).cast("long").alias("id")).where("at IS NOT NULL")
    lane = F.pmod(F.xxhash64("own"), F.lit(lanes)).cast("string") if lanes else F.col("own")
    return rows.withWatermark("at", delay).withColumn("k", lane).groupBy("k").transformWithStateInPandas(WindowLimiter(per_window, window, slot), OUTPUT, "append", "EventTime")


def run_to_end(result: DataFrame, out: str, checkpoint: str, partitions: int | None = None) -> None:
    """Take in all that the sources hold now, into Parquet files, and stop; a later call with the same checkpoint goes on.
    `partitions`: those of the state (default: the session's), which a checkpoint keeps from its first run on."""
    conf, key = result.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(key)
    conf.set(key, str(partitions or before))
    try:
        q = result.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
