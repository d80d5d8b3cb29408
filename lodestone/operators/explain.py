"""Exact Shapley contributions of tree ensembles, path-dependent: what is not known about a row goes down both sides of a split,
in proportion to the training rows on each side.

A leaf is reached by conditions on the features of its path. Under a set S of known features it is reached with the product of
its conditions that hold (S) and the shares of training rows (the others), a game whose Shapley values have a closed form:
feature i gets value * (holds_i - share_i) * the sum over sizes s of s! (p - 1 - s)! / p! times the coefficient of t^s in the
product over the other features of (share_j + holds_j t). Which conditions hold is a pattern of bits for each row, and rows of
one pattern share their contributions, so a batch costs one table of patterns and one gather for each leaf. Contributions
and the base (the expected value) add up to the prediction.

The model's nodes are read from its saved form; they are bounded by the model's depth and number of trees.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.search import sample_rows
from lodestone.session import delete, scratch

#: Rows over which mean contributions are taken.
SAMPLE = 20_000


@dataclass
class Condition:
    """All splits on one feature along a path: low < x <= high, or x in a set of categories; and the share of training rows that
    pass them."""

    feature: int
    share: float = 1.0
    low: float = -np.inf
    high: float = np.inf
    allowed: frozenset[int] | None = None

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        if self.allowed is not None:
            return np.isin(v, list(self.allowed))
        # A value that is no number goes right at every split, as in Spark.
        ok = np.ones(len(v), dtype=bool) if self.high == np.inf else v <= self.high
        return ok if self.low == -np.inf else ok & ~(v <= self.low)


@dataclass
class Leaf:
    value: float
    conditions: list[Condition]


@dataclass
class Ensemble:
    leaves: list[Leaf]
    features: int

    def base(self) -> float:
        return float(sum(leaf.value * np.prod([c.share for c in leaf.conditions]) for leaf in self.leaves))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """[rows, features]."""
        out = np.zeros((len(x), self.features))
        for leaf in self.leaves:
            if leaf.conditions:
                holds = np.stack([c.holds(x) for c in leaf.conditions], axis=1)
                bits = holds @ (1 << np.arange(holds.shape[1], dtype=np.int64))
                _, at, back = np.unique(bits, return_index=True, return_inverse=True)
                table = leaf.value * shapley(holds[at].astype(float), np.array([c.share for c in leaf.conditions]))
                out[:, [c.feature for c in leaf.conditions]] += table[back]
        return out


def shapley(holds: np.ndarray, share: np.ndarray) -> np.ndarray:
    """[patterns, p] Shapley values of a product game: `holds` of known features, `share` of unknown ones."""
    n, p = holds.shape
    weight = np.array([factorial(s) * factorial(p - 1 - s) / factorial(p) for s in range(p)])
    out = np.zeros((n, p))
    for i in range(p):
        poly = np.zeros((n, p))
        poly[:, 0] = 1
        for j in range(p):
            if j != i:
                poly[:, 1:] = share[j] * poly[:, 1:] + holds[:, j, None] * poly[:, :-1]
                poly[:, 0] *= share[j]
        out[:, i] = (holds[:, i] - share[i]) * (poly @ weight)
    return out


def leaves_of(nodes: dict[int, dict], weight: float) -> list[Leaf]:
    """The leaves of one tree with the conditions of their paths. `nodes` has id, prediction, rawCount, leftChild, rightChild, split."""
    out, open_ = [], [(0, {})]
    while open_:
        at, path = open_.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            out.append(Leaf(weight * node["prediction"], list(path.values())))
            continue
        split, rows = node["split"], max(1, node["rawCount"])
        for left, child in ((True, node["leftChild"]), (False, node["rightChild"])):
            f, values = split["featureIndex"], split["leftCategoriesOrThreshold"]
            old = path.get(f, Condition(f))
            new = Condition(f, old.share * nodes[child]["rawCount"] / rows, old.low, old.high, old.allowed)
            if split["numCategories"] < 0:
                new.low, new.high = (new.low, min(new.high, values[0])) if left else (max(new.low, values[0]), new.high)
            else:
                known = old.allowed if old.allowed is not None else frozenset(range(split["numCategories"]))
                new.allowed = known & frozenset(map(int, values)) if left else known - frozenset(map(int, values))
            open_.append((child, path | {f: new}))
    return out


def read_ensemble(model) -> Ensemble:
    """The leaves of a fitted forest or boosted trees (a Spark model), from its saved form."""
    spark = SparkSession.active()
    path = scratch(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    delete(spark, path)
    boosted = "GBT" in type(model).__name__
    leaves: list[Leaf] = []
    for tree in sorted({r["treeID"] for r in rows}):
        nodes = {r["id"]: r.asDict(recursive=True) for r in rows if r["treeID"] == tree}
        leaves += leaves_of(nodes, model.treeWeights[tree] if boosted else 1.0 / model.getNumTrees)
    return Ensemble(leaves, model.numFeatures)


def with_contributions(df: DataFrame, ensemble: Ensemble, features: str = "features", to: str = "contributions") -> DataFrame:
    """Adds the contributions of each feature (array of doubles, in the order of the model's features) to a vector column's rows."""
    shared = df.sparkSession.sparkContext.broadcast(ensemble)

    @F.pandas_udf("array<double>")
    def explained(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist(), dtype=np.float64).reshape(len(x), shared.value.features)
        return pd.Series(list(shared.value.contributions(rows)))

    return df.withColumn(to, explained(vector_to_array(features)))


def added_up(base: float, contributions: str = "contributions") -> Column:
    return F.aggregate(contributions, F.lit(base), lambda a, c: a + c)


def mean_contributions(df: DataFrame, ensemble: Ensemble, names: list[str], ident: str, features: str = "features", sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """feature, mean_abs_contribution, n_rows over at most `sample` rows, those with the least hashes of their id."""
    rows = sample_rows(df.select(ident, features), ident, sample, seed)
    each = with_contributions(rows, ensemble, features).select(F.posexplode("contributions").alias("pos", "c"))
    means = each.groupBy("pos").agg(F.avg(F.abs("c")).alias("mean_abs_contribution"), F.count("*").alias("n_rows"))
    return means.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1).alias("feature"), "mean_abs_contribution", "n_rows")


def top_contributions(df: DataFrame, names: list[str], top: int = 8, contributions: str = "contributions", features: str = "features") -> DataFrame:
    """Adds explanation: the `top` features of each row by absolute contribution, with their values; ties in the order of names."""
    labels = F.array(*[F.lit(n) for n in names])
    items = F.zip_with(F.arrays_zip(labels.alias("feature"), vector_to_array(features).alias("value")), contributions, lambda a, c: F.struct((-F.abs(c)).alias("order"), a["feature"].alias("feature"), a["value"].alias("value"), c.alias("contribution")))
    best = F.slice(F.array_sort(items), 1, top)
    return df.withColumn("explanation", F.transform(best, lambda x: x.dropFields("order")))
