"""Versioned tables: conflicts, crashes before the commit, merging on read, compaction; names that other sessions see."""

import pytest
from pyspark.sql import functions as F

from lodestone.session import scratch
from lodestone.sources import versions


@pytest.fixture
def made(spark):
    t = versions.VersionedTable(spark, scratch(spark, "table"), "id")
    assert t.create(spark.range(20).select("id", (F.col("id") * 2).alias("v"), F.lit("a").alias("extra column"))) == 0
    return t


def rows(t, version=None):
    return {r["id"]: r["v"] for r in t.read(version).collect()}


def test_versions_are_merged_on_read(spark, made):
    first = {i: 2 * i for i in range(20)}
    new = spark.createDataFrame([(3, 300, "b"), (50, 500, "b"), (4, None, None)], ["id", "v", "extra column"])
    assert made.upsert(new) == 1 and made.upsert(new) == 2
    assert made.remove(spark.createDataFrame([(3,), (7,), (999,), (None,)], "id long")) == 3
    assert made.upsert(spark.createDataFrame([(7, 70, "c")], ["id", "v", "extra column"])) == 4
    changed = first | {3: 300, 50: 500, 4: None}
    assert rows(made, 0) == first and rows(made, 1) == rows(made, 2) == changed
    last = {k: v for k, v in changed.items() if k != 3} | {7: 70}
    assert rows(made) == rows(made, 4) == last
    assert made.compact() == 5 and rows(made) == last and rows(made, 2) == changed
    assert made.sweep(5) == 5 and rows(made) == last
    with pytest.raises(ValueError):
        made.read(2)
    assert [(e["version"], e["kind"], e["rows"]) for e in made.entries()] == [(5, "snapshot", 20)]


def test_of_two_writers_one_commits(spark, made):
    seen = made.version()
    other = versions.VersionedTable(spark.newSession(), made.path, "id")
    assert made.upsert(spark.createDataFrame([(1, 10, "")], ["id", "v", "extra column"]), at=seen) == 1
    with pytest.raises(versions.Conflict):
        other.upsert(spark.createDataFrame([(1, 11, "")], ["id", "v", "extra column"]), at=seen)
    assert rows(made)[1] == 10
    assert other.upsert(spark.createDataFrame([(1, 11, "")], ["id", "v", "extra column"])) == 2 and rows(made)[1] == 11
    with pytest.raises(versions.Conflict):
        made.create(spark.range(1).select("id"))


def test_a_crash_before_the_commit_leaves_the_old_version(spark, made, monkeypatch):
    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "rename", crash)
        with pytest.raises(KeyboardInterrupt):
            made.upsert(spark.createDataFrame([(1, 10, "")], ["id", "v", "extra column"]))
    assert made.version() == 0 and rows(made)[1] == 2
    assert made.upsert(spark.createDataFrame([(2, 20, "")], ["id", "v", "extra column"])) == 1 and rows(made)[1] == 2
    assert made.sweep(0) == 1 and rows(made)[2] == 20  # only what was never committed goes


def test_repeated_keys_and_missing_tables_are_errors(spark, made):
    with pytest.raises(ValueError):
        made.upsert(spark.createDataFrame([(1, 10, ""), (1, 11, "")], ["id", "v", "extra column"]))
    with pytest.raises(ValueError):
        versions.VersionedTable(spark, scratch(spark, "none"), "id").read()
    assert made.version() == 0


def test_names_move_in_one_step(spark):
    folder = scratch(spark, "names")
    assert versions.target_of(spark, folder, "live") is None
    for target in ("one", "two", "two"):
        versions.set_name(spark, folder, "live", target)
        assert versions.target_of(spark.newSession(), folder, "live") == target
