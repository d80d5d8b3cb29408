"""Tree contributions against the sum over all subsets, and their sum against the prediction."""

import itertools
import random
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from lodestone.operators import explain, valuation


def expected(nodes, x, known, at=0):
    """The tree's value with only some features known: both sides of a split on another, by training rows."""
    n = nodes[at]
    if n["leftChild"] < 0:
        return n["prediction"]
    s, left, right = n["split"], n["leftChild"], n["rightChild"]
    if s["featureIndex"] in known:
        v = x[s["featureIndex"]]
        goes = v <= s["leftCategoriesOrThreshold"][0] if s["numCategories"] < 0 else v in s["leftCategoriesOrThreshold"]
        return expected(nodes, x, known, left if goes else right)
    return sum(nodes[c]["rawCount"] * expected(nodes, x, known, c) for c in (left, right)) / n["rawCount"]


def by_subsets(nodes, x, features):
    out = []
    for i in range(features):
        others = [f for f in range(features) if f != i]
        total = 0.0
        for k in range(features):
            for s in itertools.combinations(others, k):
                total += factorial(k) * factorial(features - 1 - k) / factorial(features) * (expected(nodes, x, {*s, i}) - expected(nodes, x, set(s)))
        out.append(total)
    return out


def random_tree(rng, features, depth):
    nodes, count = {}, itertools.count()

    def grow(rows, level):
        i = next(count)
        if level == 0 or rows < 2:
            nodes[i] = {"id": i, "prediction": rng.uniform(-5, 5), "rawCount": rows, "leftChild": -1, "rightChild": -1, "split": None}
            return i
        f, n = rng.randrange(features), rng.randint(1, rows - 1)
        split = {"featureIndex": f, "leftCategoriesOrThreshold": [rng.random()], "numCategories": -1} if f else {"featureIndex": 0, "leftCategoriesOrThreshold": [float(c) for c in range(4) if rng.random() < 0.5], "numCategories": 4}
        nodes[i] = {"id": i, "prediction": 0.0, "rawCount": rows, "split": split}
        nodes[i] |= {"leftChild": grow(n, level - 1), "rightChild": grow(rows - n, level - 1)}
        return i

    grow(200, depth)
    return nodes


def test_small_trees_equal_the_sum_over_subsets():
    rng = random.Random(2)
    for _ in range(25):
        nodes = random_tree(rng, 4, 4)
        model = explain.Ensemble(explain.leaves_of(nodes, 0.5), 4)
        rows = [[float(rng.randrange(4)), rng.random(), rng.random(), float("nan") if rng.random() < 0.2 else rng.random()] for _ in range(15)]
        got = model.contributions(np.array(rows))
        assert got == pytest.approx(np.array([[0.5 * v for v in by_subsets(nodes, x, 4)] for x in rows]))
        assert model.base() + got.sum(axis=1) == pytest.approx([0.5 * expected(nodes, x, {0, 1, 2, 3}) for x in rows])


@pytest.fixture(scope="module")
def rows(spark):
    raw = spark.range(3000).select("id", (F.rand(1) * 10).alias("a"), (F.rand(2) * 10).alias("b"), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("c"))
    return raw.withColumn("p", F.exp(F.col("a") / 5 + F.when(F.col("c") == "x", 1).otherwise(0) + F.rand(3))).withColumn("v", F.rand(5) < 0.2).persist()


def test_contributions_add_up_to_the_prediction(spark, rows):
    model = valuation.fit_price_model(rows, "p", ["a", "b"], ["c"], "v", [dict(maxDepth=4, maxIter=5)])
    ensemble = explain.read_ensemble(model.stages[-1])
    out = explain.with_contributions(model.transform(rows), ensemble)
    assert out.where(F.abs(explain.added_up(ensemble.base()) - F.col("prediction")) > 1e-6).isEmpty()
    means = {r["feature"]: r for r in explain.mean_contributions(model.transform(rows), ensemble, ["a", "b", "c"], "id", sample=500).collect()}
    assert {r["n_rows"] for r in means.values()} == {500} and means["a"]["mean_abs_contribution"] > means["b"]["mean_abs_contribution"]
    top = explain.top_contributions(out, ["a", "b", "c"], 2).select("explanation", "contributions").first()
    assert len(top["explanation"]) == 2 and abs(top["explanation"][0]["contribution"]) == max(map(abs, top["contributions"]))


def test_forests_add_up(spark, rows):
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).withColumn("label", F.log("p"))
    for model in (RandomForestRegressor(numTrees=4, maxDepth=5, seed=1).fit(data), GBTRegressor(maxIter=2, maxDepth=0, seed=1).fit(data)):
        ensemble = explain.read_ensemble(model)
        out = explain.with_contributions(model.transform(data), ensemble)
        assert out.where(F.abs(explain.added_up(ensemble.base()) - F.col("prediction")) > 1e-6).isEmpty()
        assert explain.with_contributions(data.limit(0), ensemble).isEmpty() and out.select(F.size(vector_to_array("features"))).first()[0] == 2
