"""Connected components by contraction to local minima.

Every node points to the neighbour (or itself) that is least in the round's order, and edges are rewritten to the nodes
pointed at; loops and repeated edges go. The first round takes the order of the ids, which ends stars around their least
node at once; later rounds take orders of hashes, in which the number of nodes falls by a constant factor each round, chains
included, so the rounds grow with the logarithm of the longest chain. Labels are read back through the pointers of all
rounds, last one first.

Hubs are aggregated before the shuffle, and each join has one row per node on one side, so adaptive execution can split
the other side. A round is one aggregate and one rewriting of the edges; both are written tables, deleted once they are
used, and no join broadcasts, so the driver holds nothing that grows with the rounds but small plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", least: bool = True) -> DataFrame:
    """node, component for every node that occurs in an edge. The component is named by its least node, or with
    least=False by any of its nodes, which saves two shuffles."""
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    e = materialize(edges.select(*pair(src, dst)).distinct(), "edges")
    levels: list[DataFrame] = []
    while not e.isEmpty():
        seed = len(levels)
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("id")) if seed else F.struct(F.col(c).alias("id"))  # noqa: E731, B023
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        point = materialize(both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(F.col("m"), rank("u"))["id"].alias("p")), "pointers")
        levels.append(point)
        to = lambda c: point.select(F.col("u").alias(c), F.col("p").alias(f"p{c}")).hint("merge")  # noqa: E731, B023
        moved = e.join(to("a"), "a").join(to("b"), "b").where("pa <> pb").select(*pair("pa", "pb"))
        shorter = materialize(moved.distinct(), "edges")
        release(e)
        e = shorter
    release(e)
    if not levels:
        return edges.limit(0).select(F.col(src).alias("node"), F.col(src).alias("component"))
    labels = levels.pop()
    while levels:
        before = levels.pop()
        onward = labels.select(F.col("u").alias("p"), F.col("p").alias("root")).hint("merge")
        longer = materialize(before.join(onward, "p", "left").select("u", F.coalesce("root", "p").alias("p")), "labels")
        release(labels, before)
        labels = longer
    found = labels.select(F.col("u").alias("node"), F.col("p").alias("component"))
    if not least:
        return found
    first = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(first.hint("merge"), "component").select("node", F.col("least").alias("component"))
