"""Communities by modularity against the best partition, and exact neighbours against all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import communities, graph, neighbours


def quality(edges, label):
    m, q = len(edges), 0.0
    for c in set(label.values()):
        inner = sum(label[a] == c and label[b] == c for a, b in edges)
        degree = sum((label[a] == c) + (label[b] == c) for a, b in edges)
        q += inner / m - (degree / (2 * m)) ** 2
    return q


def partitions(nodes):
    if not nodes:
        yield {}
        return
    head, *rest = nodes
    for p in partitions(rest):
        names = set(p.values())
        for c in [*names, max(names, default=-1) + 1]:
            yield p | {head: c}


def best(edges):
    nodes = sorted({x for e in edges for x in e})
    return max(quality(edges, p) for p in partitions(nodes))


CLIQUE = [(a, b) for a, b in itertools.combinations(range(4), 2)]
GRAPHS = {
    "two triangles": [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)],
    "two cliques": CLIQUE + [(a + 4, b + 4) for a, b in CLIQUE] + [(3, 4)],
    "star": [(0, i) for i in range(1, 7)],
    "ring": [(i, (i + 1) % 8) for i in range(8)],
    "pair": [(1, 2)],
}


def found(spark, edges):
    pairs = spark.createDataFrame(edges, "a long, b long")
    label = communities.modular_communities(pairs)
    return pairs, label, {r["node"]: r["community"] for r in label.collect()}


@pytest.mark.parametrize("name", GRAPHS)
def test_small_graphs_reach_the_best_partition(spark, name):
    edges = GRAPHS[name]
    pairs, label, got = found(spark, edges)
    assert set(got) == {x for e in edges for x in e} and set(got.values()) <= set(got)
    assert quality(edges, got) == pytest.approx(best(edges))
    assert graph.modularity(pairs, label).first()[0] == pytest.approx(best(edges))


def test_random_small_graphs_are_near_the_best(spark):
    rng = random.Random(4)
    for _ in range(2):
        edges = [e for e in itertools.combinations(range(8), 2) if rng.random() < 0.4]
        assert quality(edges, found(spark, edges)[2]) >= best(edges) - 0.03


def test_planted_communities_are_connected_and_found(spark):
    rng = random.Random(7)
    edges = [(a, b) for a, b in itertools.combinations(range(120), 2) if rng.random() < (0.35 if a // 30 == b // 30 else 0.01)]
    pairs, label, got = found(spark, edges + [(b, a) for a, b in edges[:50]] + [(5, 5)])
    assert communities.unconnected(pairs, label).isEmpty()
    planted = {x: x // 30 for x in got}
    assert quality(edges, got) >= quality(edges, planted) - 1e-9
    assert quality(edges, got) >= quality(edges, {r["node"]: r["community"] for r in graph.label_propagation(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()).collect()}) - 1e-9


def test_rounds_never_lower_modularity(spark):
    rng = random.Random(9)
    edges = [(a, b) for a, b in itertools.combinations(range(60), 2) if rng.random() < 0.1]
    base = communities.symmetric(spark.createDataFrame(edges, "a long, b long")).persist()
    nodes = base.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node"))
    before = -1.0
    for r in range(6):
        nodes = communities.moved(base, nodes, 2.0 * len(edges), r, r % 2 == 0)
        now = quality(edges, {x["node"]: x["c"] for x in nodes.collect()})
        assert now >= before - 1e-12
        before = now
    assert before > 0.15


def test_moves_into_one_community_are_made_together(spark):
    cliques = [(a + 10 * c, b + 10 * c) for c in range(2) for a, b in itertools.combinations(range(6), 2)]
    base = communities.symmetric(spark.createDataFrame(cliques + [(i, 100 + i) for i in range(4)], "a long, b long")).persist()
    nodes = base.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.when(F.col("node") < 10, 0).when(F.col("node") < 20, 10).otherwise(F.col("node")))
    got = {r["node"]: r["c"] for r in communities.moved(base, nodes, 68.0, 0, False).collect()}
    assert [got[100 + i] for i in range(4)] == [0] * 4


def test_no_edge_no_community(spark):
    assert communities.modular_communities(spark.createDataFrame([], "a long, b long")).isEmpty()
    assert communities.modular_communities(spark.createDataFrame([(3, 3)], "a long, b long")).isEmpty()


def test_unconnected_communities_are_told(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (2, 3)], "a long, b long")
    label = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 1)], "node long, community long")
    assert [tuple(r) for r in communities.unconnected(pairs, label).collect()] == [(1, 2)]


def all_pairs(rows, k):
    good = [(i, np.array(z)) for i, z in rows if z is not None and all(v is not None and np.isfinite(v) for v in z) and len(z) == 3]
    out = set()
    for i, z in good:
        near = sorted((((z - y) ** 2)[0] + ((z - y) ** 2)[1] + ((z - y) ** 2)[2], j) for j, y in good if j != i)[:k]
        out |= {(i, j, r) for r, (_, j) in enumerate(near, 1)}
    return out


def test_neighbours_equal_all_pairs(spark):
    """Clusters, copies (a third of all rows at one place), ties on a grid, and odd vectors."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in z]) for i, z in enumerate(rng.normal(size=(300, 3)) * rng.choice([0.01, 1, 30], size=(300, 1)))]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(200)] + [(2000 + i, [float(i % 5), float(i // 5 % 5), 0.0]) for i in range(60)]
    rows += [(3000, None), (3001, [1.0, None, 1.0]), (3002, [1.0, float("nan"), 1.0]), (3003, [1.0]), (3004, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, z array<double>")
    for leaf, k in ((16, 4), (1000, 7)):
        got = {(r["q"], r["doc_id"], r["rank"]) for r in neighbours.nearest_rows(df, "id", "z", k, 3, leaf=leaf).collect()}
        assert got == all_pairs(rows, k)
    assert neighbours.nearest_rows(df.limit(0), "id", "z", 3, 3).isEmpty()
    few = neighbours.nearest_rows(df.where("id < 3"), "id", "z", 5, 3).collect()
    assert sorted((r["q"], r["doc_id"]) for r in few) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_comparisons_grow_about_linearly(spark):
    counts = []
    for n in (4000, 16000):
        points = spark.range(n).select(F.col("id").alias("p"), F.array(*[F.rand(s) for s in (1, 2)]).alias("z"))
        seen = spark.sparkContext.accumulator(0)
        assert neighbours.nearest_points(points, 5, 2, leaf=64, count=seen).count() == 5 * n
        counts.append(seen.value)
    assert counts[1] < 6 * counts[0] < 6 * 4000 * 4000 / 4


@pytest.mark.parametrize("part", [60, 20_000])
def test_communities_of_parts(spark, part):
    """A ring of cliques, dealt to several parts and in one, which keeps all cliques whole with few jobs."""
    edges = [(8 * i + a, 8 * i + b) for i in range(20) for a, b in itertools.combinations(range(8), 2)] + [(8 * i, 8 * ((i + 1) % 20) + 1) for i in range(20)]
    pairs = spark.createDataFrame(edges, "a long, b long")
    tracker, group = spark.sparkContext.statusTracker(), f"communities-{part}"
    spark.sparkContext.setJobGroup(group, group)
    label = communities.modular_communities(pairs, part=part)
    got = {r["node"]: r["community"] for r in label.collect()}
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    cliques = {i: i // 8 for i in range(160)}
    assert set(got) == set(cliques) and quality(edges, got) >= quality(edges, cliques) - (0.03 if part == 60 else 1e-9)
    assert communities.unconnected(pairs, label).isEmpty() and (part == 60 or all(len({got[8 * i + j] for j in range(8)}) == 1 for i in range(20)))
    assert part == 60 or jobs < 100


def test_moves_of_a_part_never_lower_modularity():
    rng = np.random.default_rng(5)
    for _ in range(20):
        edges = sorted({tuple(sorted(x)) for x in rng.integers(0, 30, (60, 2)).tolist() if x[0] != x[1]})
        a, b = np.array(edges).T
        k = np.bincount(np.concatenate([a, b]), minlength=30).astype(float)
        start = rng.integers(0, 30, 30)
        c = communities.settled_part(a, b, np.ones(len(a)), k, start, 2.0 * len(a), rng)
        assert quality(edges, dict(enumerate(c.tolist()))) >= quality(edges, dict(enumerate(start.tolist()))) - 1e-9
