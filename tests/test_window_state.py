"""The limiter as a stream with state and timers, across restarts, against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestone.session import scratch
from lodestone.streaming import window_state
from lodestone.streaming.limiter import decide


def plain(rows, per_window, window):
    hits, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        own = hits.setdefault(k or "", deque())
        out[i] = decide([t], own, per_window, window)[0]
    return out


@pytest.fixture
def run(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "id long, k string, t double"

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("at", F.timestamp_millis(F.round(F.col("t") * 1000).cast("long")))
        window_state.run_to_end(window_state.limit_with_state(stream, "k", "at", "id", 2, 60.0, "10 seconds", 20.0), out, check)
        found = spark.read.schema(window_state.OUTPUT).parquet(out).where("k <> 'end'").collect()
        return {r["id"]: r["retry_after"] for r in found}, len(found), check

    return step


def test_restarts_give_the_plain_decisions(spark, run):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), round(rng.uniform(0, 2000), 3)) for i in range(400)]
    rows += [(1000 + i, "hot", 500.0) for i in range(5)]
    rows.sort(key=lambda r: r[2])
    first, n, _ = run(rows[:200])
    want = plain(rows, 2, 60.0)
    assert 0 < n < 200 and all(want[i] == w for i, w in first.items())
    run(rows[200:])
    got, n, check = run([(-1, "end", 10_000.0)])
    got, n, check = run([(-2, "end", 20_000.0)])
    assert n == len(rows) and got == want
    state = spark.read.format("statestore").option("path", check).option("stateVarName", "accepted").load()
    assert {r["key"]["k"] if "k" in r["key"].asDict() else r["key"][0] for r in state.select("key").collect()} <= {"end"}  # idle keys are swept
    assert spark.read.format("statestore").option("path", check).option("stateVarName", "waiting").load().select("key").where("key.k <> 'end'").isEmpty()


def test_waiting_hits_older_than_the_watermark_meet_the_window(spark, tmp_path):
    """A slot longer than the window: hits at its start wait while the watermark is already past the window of the last slot's."""
    source, out, check, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), "id long, k string, t double"
    rows = [(1, "a", 990.0), (2, "a", 995.0), (3, "a", 1010.0), (4, "other", 1500.0)]
    for step in (rows, [(-1, "end", 10_000.0)], [(-2, "end", 20_000.0)]):
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("at", F.timestamp_millis((F.col("t") * 1000).cast("long")))
        window_state.run_to_end(window_state.limit_with_state(stream, "k", "at", "id", 2, 60.0, "10 seconds", 1000.0), out, check)
    got = {r["id"]: r["retry_after"] for r in spark.read.schema(window_state.OUTPUT).parquet(out).where("k <> 'end'").collect()}
    assert got == plain(rows, 2, 60.0) and got[3] == 40
    state = spark.read.format("statestore").option("path", check).option("stateVarName", "accepted").load()
    assert state.select("key").where("key.k <> 'end'").isEmpty()


@pytest.mark.parametrize("lanes", [None, 3])
def test_lanes_hold_many_keys(spark, tmp_path, lanes):
    """Keys of a lane don't meet, and the state store has a row for each lane, slot and batch, not for each key."""
    source, out, check, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), "id long, k string, t double"
    rng = random.Random(3)
    rows = [(i, f"u{rng.randrange(60)}", round(rng.uniform(0, 200), 3)) for i in range(600)]
    rows.sort(key=lambda r: r[2])
    more = {"lanes": lanes} if lanes else {}
    waiting = []
    for step in (rows[:300], rows[300:], [(-1, "end", 10_000.0)], [(-2, "end", 20_000.0)]):
        spark.createDataFrame(step, schema).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("at", F.timestamp_millis(F.round(F.col("t") * 1000).cast("long")))
        window_state.run_to_end(window_state.limit_with_state(stream, "k", "at", "id", 2, 60.0, "10 seconds", 20.0, **more), out, check)
        waiting.append(spark.read.format("statestore").option("path", check).option("stateVarName", "waiting").load().count())
    found = spark.read.schema(window_state.OUTPUT).parquet(out).where("k <> 'end'").collect()
    assert {r["id"]: r["retry_after"] for r in found} == plain(rows, 2, 60.0) and len(found) == len(rows)
    assert {(r["id"], r["k"]) for r in found} == {(i, k) for i, k, _ in rows}
    assert waiting[0] > 20 if lanes is None else waiting[0] <= 3 * 11
