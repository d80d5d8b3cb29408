"""Communities by modularity, on several levels.

A level moves nodes to the neighbouring community that gains most, in rounds without conflicts; then each community becomes a node
of the next level's smaller graph, until none is merged. Labels are read back through the levels, and communities are cut into
their connected parts, which never lowers modularity. Levels start anew from the labels reached, MAX_SWEEPS times at most or until
no node moves.

Conflicts: what a node gains by moving changes with other moves of the round in two ways. The sizes of its old and its new community
change, by at most k * K / 2m for other movers of total degree K; and a neighbour may leave the community that the node moves to, or
move to the one it leaves, at the cost of the edge. Moves have an order, the highest gain first, and a move is made if its gain exceeds
what all earlier ones can cost it; the first one of both its communities is always made. So the moves of a round together never lower
modularity, most of them are made at once, and there are no windows and no sorting: a round is a fixed number of joins and aggregates
over edges and nodes. In the first round of a large level, where every node is alone and would follow one that leaves, a hash of
community and round lets about half of the communities only send, the others only receive; then no edge can be lost.

Rounds cost jobs, so they are the way of last resort. Communities are dealt to parts of a bounded number of nodes, and a task moves
the nodes of a part one after another, as long as any gains, on several levels. A part holds whole communities, so the gains of its
moves are exact, and parts don't change each other's: all of them together never lower modularity. Communities that are near each
other (regions around the least hash within a few steps) share a part, the regions differ each time, and the graph of the communities
is taken on the same way until it fits one part. Then nodes move between the communities reached, dealt anew. A graph of one part is
done by one job. Levels that hold a community above the size of a part, or that parts no longer shrink, take the rounds above.

The last few moves of a level take as many rounds as the first thousands. So a level of a sweep that another one follows goes on to the
next level while a small share of its nodes still waits; the last sweep settles every level.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components
from lodestone.session import materialize, release

#: Gains (in units of edge weight) that count as gains.
LEAST_GAIN = 1e-9
#: Rounds of a level. A level that is cut short is still a partition with a higher modularity, and the next level goes on.
MAX_ROUNDS, MAX_SWEEPS = 60, 2
#: Copies of the graph that are tried at once.
TRIES = 4
#: Nodes of a level from which on a first round with colours pays.
MANY = 500
#: Share of a level's nodes that may wait for the next sweep.
LATE = 0.01

#: Nodes, and edges by which a node counts as more than one, of a part that a task holds.
PART, DEGREE = 20_000, 16
#: Steps of a region around its least hash, and the share of a level's nodes that parts must merge to go on with parts.
STEPS, SHRINK = 3, 0.05
#: Orders of its nodes that a part tries, as long as they are not more nodes than a full part.
ORDERS = 16


def symmetric(pairs: DataFrame) -> DataFrame:
    """a, b, w in both directions; loops go, repeated pairs count once."""
    once = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.withColumn("w", F.lit(1.0))


def moved(edges: DataFrame, nodes: DataFrame, total: float, seed: int, coloured: bool) -> DataFrame:
    """One round: node, k, c, and open (a better community is known, whatever its colour this round)."""
    colour = lambda c: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(2))
    size = nodes.groupBy("c").agg(F.sum("k").alias("s"))
    to = edges.join(nodes.select(F.col("node").alias("b"), F.col("c").alias("to")), "b").groupBy("a", "to").agg(F.sum("w").alias("w"))
    own = nodes.join(size, "c").select(F.col("node").alias("a"), "k", "c", F.col("s").alias("own_size"))
    known = to.join(size.select(F.col("c").alias("to"), "s"), "to").join(own, "a")
    # Equal costs are told apart by a hash, so that copies of a graph (see below) go different ways.
    cost = F.struct((F.col("k") * F.col("s") / total - F.col("w")).alias("cost"), F.xxhash64("to").alias("h"), F.col("to").alias("to"))
    other = F.col("to") != F.col("c")
    fits = other & (colour("c") == 0) & (colour("to") == 1) if coloured else other
    best = known.groupBy("a", "k", "c", "own_size").agg(F.sum(F.when(~other, F.col("w")).otherwise(0.0)).alias("inner"), F.min(F.when(other, cost)).alias("any"), F.min(F.when(fits, cost)).alias("now"))
    stay = F.col("inner") - F.col("k") * (F.col("own_size") - F.col("k")) / total
    gain = lambda c: -F.col(f"{c}.cost") - stay
    wishes = best.select("a", "k", "c", F.col("now.to").alias("to"), gain("now").alias("gain"), F.coalesce(gain("any") > LEAST_GAIN, F.lit(False)).alias("open"))
    wishes = materialize(wishes, "wishes")
    movers = wishes.where(F.col("gain") > LEAST_GAIN)
    made = allowed(movers, None if coloured else edges, total).select(F.col("a").alias("node"), F.col("to").alias("new"))
    rest = nodes.select("node", "k", "c").join(made, "node", "left").join(wishes.select(F.col("a").alias("node"), "open"), "node", "left")
    out = materialize(rest.select("node", "k", F.coalesce("new", "c").alias("c"), F.coalesce("open", F.lit(False)).alias("open")), "nodes")
    release(wishes)
    return out


def place() -> Column:
    """The order of moves: the highest gain first."""
    return F.struct((-F.col("gain")).alias("gain"), F.xxhash64("a").alias("h"), "a")


def allowed(movers: DataFrame, edges: DataFrame | None, total: float) -> DataFrame:
    """Of moves that are to be made at once, those that gain more than they can lose by the moves before them. Without `edges`, no
    move goes to a community that another one leaves."""
    part = lambda t, out, into: F.struct(F.col(t).alias("t"), out.alias("out"), into.alias("into"))
    none = F.lit(0.0)
    each = movers.withColumn("place", place()).select("place", F.explode(F.array(part("c", F.col("k"), none), part("to", none, F.col("k")))).alias("x")).select("place", "x.*")
    touched = each.groupBy("t").agg(F.sum("out").alias("out"), F.sum("into").alias("into"), F.min("place")["a"].alias("first"))
    ends = movers.join(touched.select(F.col("t").alias("c"), "out", F.col("first").alias("first_out")), "c").join(touched.select(F.col("t").alias("to"), "into", F.col("first").alias("first_in")), "to")
    loss = F.col("k") * (F.col("out") + F.col("into") - 2 * F.col("k")) / total
    if edges is not None:
        end = lambda x: movers.select(F.col("a").alias(x), F.col("c").alias(f"c{x}"), F.col("to").alias(f"to{x}"), place().alias(f"place{x}"))
        lost = (F.col("toa") == F.col("cb")).cast("int") + (F.col("tob") == F.col("ca")).cast("int")
        pairs = edges.join(end("a"), "a").join(end("b"), "b").where((F.col("placeb") < F.col("placea")) & (lost > 0))
        ends = ends.join(pairs.groupBy("a").agg(F.sum(F.col("w") * lost).alias("lost")), "a", "left")
        loss = loss + F.coalesce("lost", F.lit(0.0))
    return ends.where((F.col("gain") > loss + LEAST_GAIN) | ((F.col("first_out") == F.col("a")) & (F.col("first_in") == F.col("a"))))


def settled(edges: DataFrame, nodes: DataFrame, total: float, rounds: int, seed: int, alone: bool = True, late: float = 0.0) -> tuple[DataFrame, bool]:
    """Rounds until no node, or no more than the share `late` of them, has a better community; also whether any node had one.
    `alone`: each node is a community of its own."""
    any_, start, n = False, nodes, nodes.count()
    for r in range(rounds):
        new = moved(edges, nodes, total, seed + r, alone and r == 0 and n >= MANY)
        waiting = new.where("open").count()
        if nodes is not start:
            release(nodes)
        nodes = new
        any_ = any_ or waiting > 0
        if waiting <= late * n:
            break
    return nodes, any_


def connected_parts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, k, c: communities cut into their connected parts, each named by its least node."""
    label = nodes.select("node", "c")
    inner = edges.where("a < b").join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").where("ca = cb").select("a", "b")
    parts = connected_components(inner, "a", "b")
    return materialize(nodes.join(parts, "node", "left").select("node", "k", F.coalesce("component", "node").alias("c")), "nodes")


def contracted(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph whose nodes are the communities; weights inside them stay in the degrees."""
    label = nodes.select("node", "c")
    e = edges.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").where("ca <> cb").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"))
    n = nodes.groupBy(F.col("c").alias("node")).agg(F.sum("k").alias("k")).withColumn("c", F.col("node"))
    return materialize(e, "edges"), materialize(n, "nodes")


def moved_alone(ends: list[list[tuple[int, float]]], k: list[float], c: list[int], total: float, rng: np.random.Generator) -> bool:
    """Move nodes one after another, each to the neighbouring community that gains most, until none gains. `c` is changed."""
    size = [0.0] * len(k)
    for i, x in enumerate(c):
        size[x] += k[i]
    todo, waits, any_ = deque(rng.permutation(len(k)).tolist()), [True] * len(k), False
    while todo:
        i = todo.popleft()
        waits[i], own, links = False, c[i], {}
        for j, w in ends[i]:
            links[c[j]] = links.get(c[j], 0.0) + w
        size[own] -= k[i]
        best, most = own, links.get(own, 0.0) - k[i] * size[own] / total + LEAST_GAIN
        for x, w in links.items():
            if x != own and w - k[i] * size[x] / total > most:
                best, most = x, w - k[i] * size[x] / total
        size[best] += k[i]
        if best != own:
            c[i], any_ = best, True
            for j, _ in ends[i]:
                if c[j] != best and not waits[j]:
                    waits[j] = True
                    todo.append(j)
    return any_


def settled_part(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, total: float, rng: np.random.Generator) -> np.ndarray:
    """Communities of the nodes of a part (edges once each), starting from `c`: levels and sweeps until no node moves."""
    while True:
        start, (ea, eb, ew), up, degree = c, (a, b, w), np.arange(len(k)), k
        while True:
            ends: list[list[tuple[int, float]]] = [[] for _ in degree]
            for i, j, x in zip(ea.tolist(), eb.tolist(), ew.tolist()):
                ends[i].append((j, x))
                ends[j].append((i, x))
            now = c.tolist() if degree is k else list(range(len(degree)))
            if not moved_alone(ends, degree.tolist(), now, total, rng) and degree is not k:
                break
            names, own = np.unique(now, return_inverse=True)
            up = own[up]
            pair = own[ea] * len(names) + own[eb]
            pairs, at = np.unique(pair[own[ea] != own[eb]], return_inverse=True)
            ew = np.bincount(at, ew[own[ea] != own[eb]], len(pairs))
            ea, eb, degree = pairs // len(names), pairs % len(names), np.bincount(own, degree, len(names))
        # Names of communities are places of nodes: the first node of each.
        c = np.unique(up, return_index=True)[1][up]
        if same_sets(start, c):
            return c


def same_sets(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two labels, both named by any numbers, divide the nodes in the same way."""
    both = len(np.unique(np.stack([x, y]), axis=1).T)
    return both == len(np.unique(x)) == len(np.unique(y))


def within_parts(edges: DataFrame, nodes: DataFrame, parts: DataFrame, total: float, seed: int) -> DataFrame:
    """node, k, c after moves inside of parts (c, part: whole communities, of a bounded number of nodes each)."""
    kind = nodes.schema["node"].dataType
    ids = kind["id"].dataType.simpleString()
    placed = nodes.join(parts, "c").select("part", "node", "k", "c")
    side = lambda x: placed.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}"))
    inner = edges.where("a < b").join(side("a"), "a").join(side("b"), "b").where("part_a = part_b")
    left = placed.select("node.copy", "part", F.col("node.id").alias("id"), "k", F.col("c.id").alias("c")).groupBy("copy", "part")
    right = inner.select("a.copy", F.col("part_a").alias("part"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), "w").groupBy("copy", "part")

    def run(key: tuple, own: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id", ignore_index=True)
        place = pd.Index(own["id"])
        e = e.assign(a=place.get_indexer(e["a"]), b=place.get_indexer(e["b"])).sort_values(["a", "b"])
        rng = np.random.default_rng([zlib.crc32(repr([int(x) for x in key]).encode()), seed])
        a, b, w, k, start = e["a"].to_numpy(), e["b"].to_numpy(), e["w"].to_numpy(), own["k"].to_numpy(), place.get_indexer(first_of(own))
        found = (settled_part(a, b, w, k, start, total, rng) for _ in range(min(ORDERS, max(1, PART // len(own)))))
        c = max(found, key=lambda c: 2 * w[c[a] == c[b]].sum() - (np.bincount(c, k) ** 2).sum() / total)
        return pd.DataFrame({"copy": own["copy"], "id": own["id"], "k": own["k"], "c": own["id"].to_numpy()[c]})

    out = left.cogroup(right).applyInPandas(run, f"copy int, id {ids}, k double, c {ids}")
    own = lambda c: F.struct(F.col("copy"), F.col(c).alias("id"))
    return materialize(out.select(own("id").alias("node"), "k", own("c").alias("c")), "nodes")


def first_of(own: pd.DataFrame) -> pd.Series:
    """Communities by their first node: a name may be that of a node elsewhere."""
    return own.groupby("c")["id"].transform("first")


def dealt_parts(edges: DataFrame, sizes: DataFrame, number: int, most: int, seed: int) -> DataFrame | None:
    """c, part of communities (node, n: their nodes): those of a region share a part, if regions are small enough. None if a
    community alone is above `most` nodes."""
    if number == 1:
        return sizes.select(F.col("node").alias("c"), F.lit(0).alias("part"))
    hashed = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("id"))
    root = sizes.select("node", "n", hashed("node").alias("root"))
    links = edges.select("a", "b").unionByName(sizes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    at = root.select("node", "root")
    for _ in range(STEPS):
        at = links.join(at.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("root")).withColumnRenamed("a", "node")
    part = lambda c: F.pmod(F.xxhash64(F.lit(seed + 1), c), F.lit(number)).cast("int").alias("part")
    near = materialize(at.join(sizes, "node").select(F.col("node").alias("c"), part("root.id"), part("node").alias("alone"), "n"), "parts")
    largest = lambda c: near.groupBy("c.copy", c).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    for column in ("part", "alone"):
        if largest(column) <= most:
            out = near.select("c", F.col(column).alias("part"))
            out.stored_at = near.stored_at
            return out
    release(near)
    return None


def part_round(edges: DataFrame, nodes: DataFrame, total: float, number: int, most: int, seed: int) -> DataFrame | None:
    """One round of moves inside of parts; None if a community doesn't fit one."""
    sizes = materialize(nodes.groupBy(F.col("c").alias("node")).agg(F.count("*").alias("n")), "sizes")
    links = contracted(edges, nodes) if number > 1 else ()
    parts = dealt_parts(links[0] if links else edges, sizes, number, most, seed)
    out = None if parts is None else within_parts(edges, nodes, parts, total, seed)
    release(sizes, *links, *([] if parts is None else [parts]))
    return out


def modular_communities(pairs: DataFrame, rounds: int = MAX_ROUNDS, sweeps: int = MAX_SWEEPS, seed: int = 0, tries: int = TRIES, part: int = PART) -> DataFrame:
    """node, community of every node that occurs in a pair (a, b); a community is connected and named by one of its nodes.
    No edge: no row. The graph is taken `tries` times at once, as copies that share the rounds but break ties in their own ways, and
    the copy with the highest modularity is the answer; on a large graph, one copy costs least. `part`: nodes of a part."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("copy")
    own = lambda c: F.struct(F.col("copy"), F.col(c).alias("id")).alias(c)
    base = materialize(symmetric(pairs).select("*", copies).select(own("a"), own("b"), "w"), "edges")
    total = (base.agg(F.sum("w")).first()[0] or 0.0) / tries
    start = materialize(base.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node")), "nodes")
    if not total:
        return start.select("node.id", F.col("c.id").alias("community")).toDF("node", "community")

    def number(e: DataFrame, n: DataFrame) -> int:
        return max(1, -(-max(n.count(), e.count() // DEGREE) // (tries * part)))

    def moved_all(e: DataFrame, n: DataFrame, s: int) -> tuple[DataFrame, bool]:
        """A level's moves, and whether all of it met in one part."""
        parts = number(e, n)
        out = part_round(e, n, total, parts, 2 * part, s)
        return (settled(e, n, total, rounds, s, alone=False)[0], False) if out is None else (out, parts == 1)

    nodes = start
    for sweep in range(sweeps):
        labels, whole = moved_all(base, nodes, seed + 1000 * sweep)
        level = 1
        e, n = contracted(base, labels)
        while not whole and not e.isEmpty():
            found, whole = moved_all(e, n, seed + 1000 * sweep + 100 * level)
            before, after = n.count(), found.select("c").distinct().count()
            if not whole and after > (1 - SHRINK) * before:
                rest, any_ = settled(e, found, total, rounds, seed + 1000 * sweep + 100 * level + 50, alone=False)
                release(found)
                found, whole = rest, not any_
            through = found.select(F.col("node").alias("c"), F.col("c").alias("up"))
            longer = materialize(labels.join(through, "c").select("node", "k", F.col("up").alias("c")), "labels")
            smaller = contracted(e, found)
            release(found, labels, e, n)
            labels, (e, n), level = longer, smaller, level + 1
        release(e, n, nodes)
        nodes = labels
        if level == 1 and whole:
            break
    labels, nodes = nodes, connected_parts(base, nodes)
    release(labels)
    best = best_copy(base, nodes, total)
    out = nodes.where(F.col("node.copy") == best).select(F.col("node.id").alias("node"), F.col("c.id").alias("community"))
    out.stored_at = nodes.stored_at
    release(base)
    return out


def best_copy(edges: DataFrame, nodes: DataFrame, total: float) -> int:
    """The copy of the graph with the highest modularity; ties go to the first."""
    label = nodes.select("node", "c")
    inner = edges.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").where("ca = cb").groupBy("a.copy").agg((F.sum("w") / total).alias("q"))
    degree = nodes.groupBy("c").agg(F.sum("k").alias("s")).groupBy("c.copy").agg(F.sum(-F.pow(F.col("s") / total, 2)).alias("q"))
    # Dealt out anew, as in search.hybrid().
    sums = inner.unionByName(degree).repartition("copy").groupBy("copy").agg(F.round(F.sum("q"), 12).alias("q"))
    return sums.agg(F.min(F.struct((-F.col("q")).alias("q"), "copy"))["copy"]).first()[0]


def unconnected(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The communities (of `label`: node, community) that fall into several parts, with their number."""
    inner = pairs.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").where("ca = cb AND a <> b").select("a", "b")
    parts = connected_components(inner, "a", "b")
    own = label.join(parts, "node", "left").select("community", F.coalesce("component", "node").alias("part"))
    return own.groupBy("community").agg(F.countDistinct("part").alias("parts")).where("parts > 1")
