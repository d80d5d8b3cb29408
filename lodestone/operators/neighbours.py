"""Exact nearest neighbours by Euclidean distance, without comparing all rows with all.

Rows at the same place are one point, which keeps its least ids only, so copies cost nothing. A k-d tree is built over a
bounded sample of points; its leaves deal out all points. Points meet those of their own leaf first, in blocks, which bounds
the distance of the k-th neighbour from above. A leaf whose bounding box lies farther than that can't hold a nearer point; the
others are looked up by descending the tree once for each block of queries, and the queries meet the points of those leaves.
After that the k nearest are certain. Comparisons grow with the number of points times the size of a leaf and the number of
leaves around it, which the number of dimensions decides and the number of points does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.collection import blocks
from lodestone.session import materialize, release

#: Points of a leaf (as the sample tells), of the sample, of a block; leaves of a tree (their boxes are sent to all tasks).
LEAF, SAMPLE, BLOCK, MAX_LEAVES = 256, 200_000, 512, 1 << 16
#: Boxes are taken a little larger, since distances to them are rounded otherwise than distances between points.
SLACK = 1 + 1e-9


@dataclass
class Tree:
    """Inner nodes have a dimension, a cut and two children; a leaf has dim -1. Boxes are those of the points in it."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaf_of(self, z: np.ndarray) -> np.ndarray:
        at = np.zeros(len(z), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.dim[at] >= 0)
            if not len(inner):
                return at
            own = at[inner]
            at[inner] = np.where(z[inner, self.dim[own]] <= self.cut[own], self.left[own], self.right[own])

    def with_boxes(self, boxes: dict[int, tuple[list[float], list[float]]]) -> Tree:
        """The tree with the boxes of its leaves; an inner node's box holds those of its children. Children come behind parents."""
        for node in range(len(self.dim) - 1, -1, -1):
            if self.dim[node] >= 0:
                self.low[node] = np.minimum(self.low[self.left[node]], self.low[self.right[node]])
                self.high[node] = np.maximum(self.high[self.left[node]], self.high[self.right[node]])
            elif node in boxes:
                self.low[node], self.high[node] = boxes[node]
        return self

    def near(self, z: np.ndarray, bound: np.ndarray, own: int) -> list[tuple[int, np.ndarray]]:
        """Leaves but `own` that may hold a point within the bound (squared) of some rows of z, and these rows."""
        out, low, high, most = [], z.min(axis=0), z.max(axis=0), bound.max() * SLACK
        open_ = [0]
        while open_:
            node = open_.pop()
            gap = np.maximum(0, np.maximum(self.low[node] - high, low - self.high[node]))
            if not (gap * gap).sum() <= most:
                continue
            if self.dim[node] >= 0:
                open_ += [int(self.left[node]), int(self.right[node])]
            elif node != own:
                gaps = np.maximum(0, np.maximum(self.low[node] - z, z - self.high[node]))
                rows = np.flatnonzero((gaps * gaps).sum(axis=1) <= bound * SLACK)
                if len(rows):
                    out.append((node, rows))
        return out


def grow(sample: np.ndarray, leaf: int, dims: int) -> Tree:
    """A k-d tree over a sample: the widest dimension is cut at its median until a leaf holds at most `leaf` of the sample."""
    dim, cut, left, right = [], [], [], []
    todo = [(sample, None)]
    while todo:
        points, parent = todo.pop(0)
        node = len(dim)
        if parent is not None:
            (left if parent[1] else right)[parent[0]] = node
        d, c = -1, 0.0
        if len(points) > leaf and len(points):
            d = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            c = float(np.median(points[:, d]))
            if not (points[:, d] > c).any():  # the median is the largest value: cut below it
                below = points[:, d][points[:, d] < c]
                d, c = (d, float(below.max())) if len(below) else (-1, 0.0)
        dim.append(d)
        cut.append(c)
        left.append(-1)
        right.append(-1)
        if d >= 0:
            todo += [(points[points[:, d] <= c], (node, True)), (points[points[:, d] > c], (node, False))]
    n = len(dim)
    return Tree(np.array(dim), np.array(cut), np.array(left), np.array(right), np.full((n, dims), np.inf), np.full((n, dims), -np.inf))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, dimension by dimension, so that equal points are at exactly 0."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def nearest_of(met: DataFrame, k: int, dims: int, count: Accumulator | None) -> DataFrame:
    """q, p, d: of each pair of blocks (q_q, q_z, maybe q_bound; p_p, p_z) the k nearest points of each query, not itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                q, p = np.array(pair["q_q"], dtype=np.int64), np.array(pair["p_p"], dtype=np.int64)
                d = squares(np.frombuffer(b"".join(pair["q_z"])).reshape(-1, dims), np.frombuffer(b"".join(pair["p_z"])).reshape(-1, dims))
                if count is not None:
                    count.add(d.size)
                d[q[:, None] == p[None, :]] = np.inf
                if "q_bound" in pair:
                    d[d > np.array(pair["q_bound"])[:, None]] = np.inf
                # Ties at the k-th distance go to the least id: points are in the order of ids in their block.
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(d, order, axis=1)
                at, col = np.nonzero(best < np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(p[order[at, col]]), pa.array(best[at, col])], names=["q", "p", "d"])

    return met.mapInArrow(run, "q long, p long, d double")


def least(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def packed(rows: DataFrame, columns: dict[str, str], prefix: str) -> DataFrame:
    """Blocks of rows by leaf (as `cell`). Ranges of (leaf, id) split a leaf of any size."""
    ident = next(iter(columns))
    return blocks(rows.repartitionByRange("cell", ident).sortWithinPartitions("cell", ident), columns, BLOCK, prefix)


def nearest_points(points: DataFrame, k: int, dims: int, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 42, count: Accumulator | None = None) -> DataFrame:
    """q, p, d, rank: the k nearest other points of each point (columns p and z, an array of `dims` doubles; p once each)."""
    spark = points.sparkSession
    n = points.count()
    share = min(1 << 30, -(-(min(n, sample) << 30) // max(1, n)))
    drawn = points.where(F.pmod(F.xxhash64(F.lit(seed), "p"), F.lit(1 << 30)) < share).select("z").limit(2 * sample).collect()
    wanted = min(MAX_LEAVES, max(1, n // leaf))
    tree = grow(np.array([r["z"] for r in drawn], dtype=np.float64).reshape(len(drawn), dims), max(1, len(drawn) // wanted), dims)
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array(batch.column("z").to_pylist(), dtype=np.float64).reshape(len(batch), dims)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.leaf_of(z).astype(np.int32)), batch.column("p"), pa.array([x.tobytes() for x in z], pa.binary()), batch.column("z")], names=["cell", "p", "z", "array"])

    dealt = materialize(points.select("p", "z").mapInArrow(deal, "cell int, p long, z binary, array array<double>"), "points")
    ends = [f(F.col("array")[j]) for j in range(dims) for f in (F.min, F.max)]
    boxes = {r[0]: ([r[1 + 2 * j] for j in range(dims)], [r[2 + 2 * j] for j in range(dims)]) for r in dealt.groupBy("cell").agg(*ends).collect()}
    boxed = spark.sparkContext.broadcast(tree.with_boxes(boxes))
    at = materialize(packed(dealt.select("cell", "p", "z"), {"p": "long", "z": "binary"}, "p_"), "blocks")
    asked = at.select("cell", F.col("p_p").alias("q_q"), F.col("p_z").alias("q_z"))
    first = materialize(least(nearest_of(at.join(asked, "cell").select("q_q", "q_z", "p_p", "p_z"), k, dims, count), "q", ["d", "p"], k), "nearest")
    bound = first.where(F.col("rank") == k).select(F.col("q").alias("p"), F.col("d").alias("bound"))
    queries = dealt.select("cell", "p", "z").join(bound, "p", "left").select("cell", F.col("p").alias("q"), "z", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                q, raw, far = np.array(block["q_q"], dtype=np.int64), block["q_z"], np.array(block["q_bound"])
                for node, rows in boxed.value.near(np.frombuffer(b"".join(raw)).reshape(-1, dims), far, block["cell"]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), node, dtype=np.int32)), pa.array(q[rows]), pa.array([raw[i] for i in rows], pa.binary()), pa.array(far[rows])], names=["cell", "q", "z", "bound"])

    kinds = {"q": "long", "z": "binary", "bound": "double"}
    around = packed(queries, kinds, "q_").mapInArrow(widen, "cell int, q long, z binary, bound double")
    more = nearest_of(packed(around, kinds, "q_").join(at, "cell").select("q_q", "q_z", "q_bound", "p_p", "p_z"), k, dims, count)
    out = materialize(least(first.select("q", "p", "d").unionByName(more), "q", ["d", "p"], k), "nearest")
    release(dealt, at, first)
    return out


def nearest_rows(rows: DataFrame, ident: str, vector: str, k: int, dims: int, **more) -> DataFrame:
    """q, doc_id, d (squared distance), rank: the k nearest other rows of each row, ties to the least id. Ids are numbers and come
    once each; rows whose vector is null, of another length or not finite have no neighbour and are none."""
    finite = F.forall("z", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    good = rows.select(F.col(ident).cast("long").alias("id"), F.transform(F.col(vector), lambda v: v.cast("double") + F.lit(0.0)).alias("z")).where((F.size("z") == dims) & finite & F.col("id").isNotNull())
    good = materialize(good, "rows")
    own = least(good, "z", ["id"], k + 1).groupBy("z").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("p"), "z", "ids")
    points = materialize(own, "points")
    near = nearest_points(points.select("p", "z"), k, dims, **more)
    ids = points.select("p", "ids")
    others = near.join(ids, "p").select(F.col("q").alias("p"), F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))).alias("at"))
    mine = ids.select("p", F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id"))).alias("at"))
    # At most k + 1 points of at most k + 1 ids each meet here.
    best = others.unionByName(mine).groupBy("p").agg(F.slice(F.sort_array(F.flatten(F.collect_list("at"))), 1, k + 1).alias("at"))
    placed = good.join(points.select("p", "z"), "z").select("id", "p").join(best, "p")
    hits = placed.select(F.col("id").alias("q"), F.posexplode(F.slice(F.filter("at", lambda x: x["id"] != F.col("id")), 1, k)).alias("pos", "x"))
    return hits.select("q", F.col("x.id").alias("doc_id"), F.col("x.d").alias("d"), (F.col("pos") + 1).alias("rank"))
