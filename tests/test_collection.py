"""The vector collection against exact search, its filters, odd vectors and hot cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import collection, search
from lodestone.session import scratch

DIMS = 16


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors, a third of them copies of one, and odd ones."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, DIMS))
    rows = [(i, (middles[i % 30] + 0.3 * rng.normal(size=DIMS)).tolist() if i % 3 else [1.0] * DIMS, i % 7, f"p{i % 2}") for i in range(3000)]
    rows += [(3000, None, 1, "p0"), (3001, [0.0] * DIMS, 1, "p0"), (3002, [float("nan")] + [1.0] * (DIMS - 1), 1, None), (3003, [None] + [1.0] * (DIMS - 1), 1, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, place string")


@pytest.fixture(scope="module")
def made(spark, vectors):
    path = scratch(spark, "collection")
    assert collection.write_collection(vectors, "vec_id", "embedding", path, DIMS, ["label", "place"])
    return collection.open_collection(spark, path)


def test_counts_and_a_second_write(spark, vectors, made):
    assert made.rows.where("cell = -1").count() == 4
    row = collection.info(made).first()
    assert (row["points"], row["indexed"]) == (3004, 3000) and row["cells"] > 10
    assert collection.count_range(made, 100, 199) == 100
    assert collection.write_collection(vectors, "vec_id", "embedding", made.path, DIMS) is False
    with pytest.raises(ValueError):
        collection.write_collection(vectors, "vec_id", "embedding", made.path, DIMS + 1)
    with pytest.raises(ValueError):
        collection.write_collection(vectors, "vec_id", "embedding", scratch(spark, "collection"), DIMS + 1)
    with pytest.raises(ValueError):
        collection.write_collection(vectors.unionByName(vectors.limit(1)), "vec_id", "embedding", scratch(spark, "collection"), DIMS)


def test_recall_and_exact_scores(spark, vectors, made):
    queries = vectors.where("vec_id % 50 = 1")
    found, exact = collection.search(made, queries, "vec_id", "embedding", 10), search.dense_batch(vectors, queries, "vec_id", "embedding", 10)
    assert collection.recall(found, exact).first()["recall"] >= 0.9
    assert found.groupBy("q").count().where("count <> 10").isEmpty()
    assert found.join(exact, ["q", "doc_id"]).where(F.abs(found["score"] - exact["score"]) > 1e-8).isEmpty()
    every = collection.search(made, queries, "vec_id", "embedding", 10, probes=10_000, oversample=400)
    assert {tuple(r) for r in every.collect()} == {tuple(r) for r in exact.select(*every.columns).collect()}


def test_filters_reach_the_scan_and_short_answers_are_whole(spark, vectors, made):
    queries = vectors.where("vec_id % 50 = 1")
    found = collection.search(made, queries, "vec_id", "embedding", 10, (F.col("label") == 3) & (F.col("place") == "p1"))
    assert found.join(vectors, F.col("doc_id") == F.col("vec_id")).where("label <> 3 OR place <> 'p1'").isEmpty()
    # Fewer rows pass than are asked for: all of them are found, however few cells a search begins with.
    rare = collection.search(made, queries, "vec_id", "embedding", 10, F.col("vec_id" if False else "id").isin([5, 7, 3000, 3001]), probes=1)
    assert sorted({r["doc_id"] for r in rare.collect()}) == [5, 7] and rare.groupBy("q").count().where("count <> 2").isEmpty()
    plan = collection.candidates(made, collection.probes_of(made, queries.selectExpr("vec_id AS q", "embedding AS x"), 2), 5, F.col("label") == 3)
    text = plan._jdf.queryExecution().explainString(plan.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(x for x in text.split("\n\n\n") if "PushedFilters" in x and "label" in x)
    assert "EqualTo(label,3)" in scan and "vector" not in scan.split("ReadSchema")[1]


def test_hot_and_odd_queries(spark, vectors, made):
    queries = spark.createDataFrame([(9000 + i, [1.0] * DIMS) for i in range(700)] + [(1, None), (2, [0.0] * DIMS), (None, [1.0] * DIMS)], "vec_id long, embedding array<float>")
    found = collection.search(made, queries, "vec_id", "embedding", 3)
    rows = found.collect()
    assert len(rows) == 2100 and all(r["doc_id"] % 3 == 0 and r["score"] == pytest.approx(1) for r in rows)


def test_blocks_hold_all_rows_once(spark):
    rows = spark.range(0, 5000, 1, 3).selectExpr("cast(id % 2500 / 900 as int) AS cell", "id", "cast(id as float) AS scale")
    packed = collection.blocks(rows, {"id": "long", "scale": "float"}, 64, "r_").collect()
    assert sorted(i for r in packed for i in r["r_id"]) == list(range(5000)) and max(len(r["r_id"]) for r in packed) == 64
    assert all(int(i % 2500 / 900) == r["cell"] for r in packed for i in r["r_id"])


def test_empty_collection(spark):
    path = scratch(spark, "collection")
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert collection.write_collection(none, "vec_id", "embedding", path, DIMS)
    c = collection.open_collection(spark, path)
    assert collection.search(c, spark.createDataFrame([(1, [1.0] * DIMS)], none.schema), "vec_id", "embedding", 3).isEmpty()


def test_queries_with_all_cells_come_in_bounded_batches(spark, monkeypatch):
    """A query that probes all cells is as many rows: few of them are held at once, however many cells there are."""
    import numpy as np

    assert collection.queries_at_once(40, 3) == collection.QUERIES
    for cells in (500, 5000, collection.MAX_CELLS):
        at_once = collection.queries_at_once(cells, cells)
        assert at_once == 1 or at_once * cells <= min(collection.PRODUCTS, collection.PROBED)
    monkeypatch.setattr(collection, "PROBED", 100)
    centres = np.eye(30, dtype=np.float32)
    made = collection.Collection("", 30, centres, spark.range(0), 1)
    queries = spark.createDataFrame([(i, [float(j == i % 30) + 0.01 * (j == (i + 1) % 30) for j in range(30)]) for i in range(20)], "q long, x array<double>")
    got = collection.probes_of(made, queries, 30).collect()
    assert len(got) == 600 and len({(r["q"], r["cell"]) for r in got}) == 600
    first = {r["q"]: r["cell"] for r in collection.probes_of(made, queries, 1).collect()}
    assert first == {i: i % 30 for i in range(20)}
