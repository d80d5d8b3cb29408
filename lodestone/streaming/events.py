"""Event streams as tables: protocol checks, merging, retry delays and bounded slots."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def protocol(events: DataFrame, stream: str, order: list[str], kind: str, opens: str = "meta", closes: str = "done") -> DataFrame:
    """stream, n, fault (null for a sound stream): a stream begins with `opens` and ends with `closes`, which it has once.

    One aggregate, so a stream's events never meet in one cell.
    """
    at = F.struct(*order)
    agg = events.groupBy(stream).agg(F.count("*").alias("n"), F.min_by(kind, at).alias("first"), F.max_by(kind, at).alias("last"), F.count_if(F.col(kind) == closes).alias("closed"))
    fault = F.when(~F.col("first").eqNullSafe(F.lit(opens)), f"begins without {opens}").when(F.col("closed") == 0, f"no {closes}").when(F.col("closed") > 1, f"more than one {closes}").when(~F.col("last").eqNullSafe(F.lit(closes)), f"goes on after {closes}")
    return agg.select(stream, "n", fault.alias("fault"))


def merged(streams: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """The rows of several streams as one, with source (place in the list) and pos: the row's place in the order of its key.
    Ties go to the earlier stream."""
    tagged = [s.withColumn("source", F.lit(i)) for i, s in enumerate(streams)]
    both = reduce(DataFrame.unionByName, tagged)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(order[0], "source", *order[1:])))


def retry_delay(attempt: Column, retry_after: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds to wait before the next attempt (the first is 0): what the other side asks for, else doubled each time, up to `most`."""
    return F.coalesce(retry_after.cast("double"), F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt)))


class Gate:
    """`total` slots: a request gets all of its slots at once, as soon as so many are free and all earlier requests have started
    or given up; it gives up if it would wait longer than `patience`."""

    def __init__(self, total: int, patience: float):
        self.total, self.patience = total, patience
        self.free, self.now = total, float("-inf")
        self.ends: list[tuple[float, int]] = []  # a heap of running requests

    def ask(self, arrival: float, duration: float, slots: int) -> float | None:
        """The start of a request, or None; requests come in order of arrival."""
        now = max(self.now, arrival)
        while self.ends and self.ends[0][0] <= now:
            self.free += heapq.heappop(self.ends)[1]
        start, have, ended = now, self.free, []
        while have < slots and self.ends:
            ended.append(heapq.heappop(self.ends))
            start, have = ended[-1][0], have + ended[-1][1]
        if have < slots or start - arrival > self.patience:
            for x in ended:
                heapq.heappush(self.ends, x)
            return None
        self.now, self.free = start, have - slots
        heapq.heappush(self.ends, (start + duration, slots))
        return start


def bounded_slots(df: DataFrame, key: str, arrival: str, duration: str, slots: str, ident: str, total: int, patience: float) -> DataFrame:
    """ident, start (seconds; null: gave up) of every request; each key has `total` slots. A task holds one batch and the running
    requests of the current key."""
    rows = df.select(F.col(key).alias("k"), F.col(arrival).cast("double").alias("a"), F.col(duration).cast("double").alias("d"), F.col(slots).cast("int").alias("s"), F.col(ident).alias("i"))
    rows = rows.repartition("k").sortWithinPartitions("k", "a", "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, gate = object(), None
        for b in batches:
            out = []
            for k, a, d, s in zip(b["k"], b["a"], b["d"], b["s"]):
                if k != last:
                    last, gate = k, Gate(total, patience)
                out.append(gate.ask(a, d, s))
            yield pd.DataFrame({ident: b["i"], "start": pd.array(out, dtype="Float64")})

    return rows.mapInPandas(run, f"{ident} bigint, start double")
