"""Spatial join of points with areas, by a cover of grid cells.

An area is a set of rings under the even-odd rule, so holes and several parts need no marks of their own. The cover of an area
has the grid cells inside it, which accept every point, and the cells that its border passes, which carry the few edges that
can decide a point in them: those that overlap the cell's row and do not lie wholly to its left, since the rule counts the
edges to the right of a point. So the join is one of cells by equality, the test a filter over a short array, and its result
is that of the rule over all edges, to the last bit. Areas may overlap; a point comes once for each area that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of one area at most: an area so large for its grid is an error, not a slow answer.
MAX_CELLS = 4_000_000
#: Vertices that are broadcast in one pass of the search for the nearest one (16 bytes each).
VERTICES = 1 << 20
EDGE = "struct<x0: double, y0: double, x1: double, y1: double>"


def edges_of(rings: list) -> np.ndarray:
    """[edges, 4]: each ring is closed; rings of fewer than three vertices have none."""
    out = [np.concatenate((r, np.roll(r, -1, axis=0)), axis=1) for r in (np.array(ring, dtype=np.float64).reshape(-1, 2) for ring in rings or [] if ring is not None) if len(r) > 2]
    return np.concatenate(out) if out else np.zeros((0, 4))


def inside(x: np.ndarray, y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd rule for points against all edges, edge by edge."""
    odd = np.zeros(len(x), dtype=bool)
    for x0, y0, x1, y1 in edges:
        cross = (y0 > y) != (y1 > y)
        if cross.any():
            odd[cross] ^= x[cross] < (x1 - x0) * (y[cross] - y0) / (y1 - y0) + x0
    return odd


def cover_of(edges: np.ndarray, size: float) -> Iterator[tuple[int, int, bool, np.ndarray | None]]:
    """cell x, cell y, whether the cell is inside, and the deciding edges of a border cell."""
    cell = lambda v: np.floor(v / size).astype(np.int64)
    left, right = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    columns, rows = (int(cell(left.min())), int(cell(right.max()))), (int(cell(low.min())), int(cell(high.max())))
    width = columns[1] - columns[0] + 1
    if width * (rows[1] - rows[0] + 1) > MAX_CELLS:
        raise ValueError(f"an area covers more than {MAX_CELLS} cells of size {size}")
    for row in range(rows[0], rows[1] + 1):
        band = edges[(low <= (row + 1) * size) & (high >= row * size)]
        border = np.zeros(width + 1, dtype=np.int64)
        for x0, y0, x1, y1 in band:
            # The part of the edge within the band, widened by a hair against rounding.
            t = np.clip((np.array([row * size, (row + 1) * size]) - y0) / (y1 - y0), 0, 1) if y0 != y1 else np.array([0.0, 1.0])
            xs = x0 + t * (x1 - x0)
            hair = 1e-9 * (1 + abs(x0) + abs(x1))
            a, b = cell(xs.min() - hair) - columns[0], cell(xs.max() + hair) - columns[0]
            border[max(0, a)] += 1
            border[min(width - 1, b) + 1] -= 1
        at_border = np.cumsum(border[:-1]) > 0
        middle = inside((columns[0] + np.arange(width) + 0.5) * size, np.full(width, (row + 0.5) * size), band)
        most = np.maximum(band[:, 0], band[:, 2]) if len(band) else np.zeros(0)
        for k in np.flatnonzero(at_border | middle).tolist():
            x = columns[0] + k
            yield x, row, bool(middle[k]), band[most >= x * size - 1e-9 * (1 + abs(x * size))] if at_border[k] else None


def cover(areas: DataFrame, area: str, rings: str, size: float) -> DataFrame:
    """area, cx, cy, inside, edges (null for a cell that is all inside) of every area. `rings` is an array of rings of [x, y]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                edges = edges_of(batch.column("rings")[i].as_py())
                found = list(cover_of(edges, size)) if len(edges) else []
                for a in range(0, len(found), 4096):
                    part = found[a : a + 4096]
                    lists = [None if e is None else [dict(zip(("x0", "y0", "x1", "y1"), v)) for v in e.tolist()] for *_, e in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("area")[i].as_py()] * len(part), batch.schema.field("area").type), *[pa.array([p[k] for p in part], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.bool_()))],
                         pa.array(lists, pa.list_(pa.struct([(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")])))],
                        names=["area", "cx", "cy", "inside", "edges"],
                    )

    rows = areas.select(F.col(area).alias("area"), F.col(rings).alias("rings"))
    kind = rows.schema["area"].dataType.simpleString()
    return rows.mapInArrow(run, f"area {kind}, cx long, cy long, inside boolean, edges array<{EDGE}>")


def crosses(x: Column, y: Column, e: Column) -> Column:
    """Whether an edge lies to the right of a point at its height."""
    at = F.try_divide((e["x1"] - e["x0"]) * (y - e["y0"]), e["y1"] - e["y0"]) + e["x0"]
    return ((e["y0"] > y) != (e["y1"] > y)) & F.coalesce(x < at, F.lit(False))


def join_areas(points: DataFrame, x: str, y: str, areas: DataFrame, area: str, rings: str, size: float, to: str = "area", how: str = "inner") -> DataFrame:
    """The points with `to`, once for each area that holds them; with how="left", points in no area come once with a null."""
    cells = cover(areas, area, rings, size).select(F.col("area").alias("__area"), F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.col("inside").alias("__inside"), F.col("edges").alias("__edges"))
    at = points.withColumns({"__px": F.floor(F.col(x) / size).cast("long"), "__py": F.floor(F.col(y) / size).cast("long")})
    odd = F.size(F.filter("__edges", lambda e: crosses(F.col(x), F.col(y), e))) % 2 == 1
    on = (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")) & F.when(F.col("__edges").isNull(), F.col("__inside")).otherwise(odd)
    return at.join(cells, on, how).select(*points.columns, F.col("__area").alias(to))


def vertices(areas: DataFrame, area: str, rings: str) -> DataFrame:
    points = areas.select(F.col(area).alias("area"), F.explode(F.flatten(rings)).alias("v"))
    return points.select("area", F.col("v")[0].alias("vx"), F.col("v")[1].alias("vy"))


def nearest_area(points: DataFrame, ident: str, x: str, y: str, areas: DataFrame, area: str, rings: str, per_pass: int = VERTICES) -> DataFrame:
    """ident, area, distance: the area of the nearest vertex of each point, ties to the least area. Vertices are sent to the points
    in slices of about `per_pass`, one pass over the points for each; points beside no vertex at all have no row."""
    corners = vertices(areas, area, rings).distinct()
    passes, out = max(1, -(-corners.count() // per_pass)), None
    rows = points.select(F.col(ident).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    kind = corners.select("area").limit(0).toArrow().schema.field(0).type
    kinds = (rows.schema["id"].dataType.simpleString(), corners.schema["area"].dataType.simpleString())
    for p in range(passes):
        own = corners.where(F.pmod(F.xxhash64("vx", "vy", "area"), F.lit(passes)) == p).orderBy("area", "vx", "vy").collect()
        names, at = [r["area"] for r in own], np.array([(r["vx"], r["vy"]) for r in own]).reshape(-1, 2)
        shared = points.sparkSession.sparkContext.broadcast((names, at))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, at = shared.value
            step = max(1, (1 << 21) // max(1, len(at)))
            for batch in batches if len(at) else ():
                for a in range(0, len(batch), step):
                    part = batch.slice(a, step)
                    gap_x = part.column("x").to_numpy(zero_copy_only=False)[:, None] - at[None, :, 0]
                    gap_y = part.column("y").to_numpy(zero_copy_only=False)[:, None] - at[None, :, 1]
                    square = gap_x * gap_x + gap_y * gap_y
                    best = square.argmin(axis=1)  # the first of equal ones has the least area
                    yield pa.RecordBatch.from_pydict({"id": part.column("id"), "area": pa.array([names[k] for k in best], kind), "square": square[np.arange(len(best)), best]})

        found = rows.mapInArrow(near, f"id {kinds[0]}, area {kinds[1]}, square double")
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("id").agg(F.min(F.struct("square", "area")).alias("b"))
    return best.select(F.col("id").alias(ident), "b.area", F.sqrt("b.square").alias("distance"))


def probes(areas: DataFrame, area: str, rings: str, grid: int = 9) -> DataFrame:
    """area, x, y: the points of a grid over each area's box that lie in it; for an area that holds none, its mean vertex."""
    all_ = F.flatten(rings)
    low = lambda k: F.array_min(F.transform(all_, lambda v: v[k]))
    high = lambda k: F.array_max(F.transform(all_, lambda v: v[k]))
    mean = lambda k: F.aggregate(all_, F.lit(0.0), lambda a, v: a + v[k]) / F.size(all_)
    boxes = areas.select(F.col(area).alias("area"), F.col(rings).alias("rings"), *[f(k).alias(f"{n}{k}") for n, f in (("low", low), ("high", high), ("mean", mean)) for k in (0, 1)])
    steps = F.sequence(F.lit(0), F.lit(grid - 1))
    at = lambda k, i: F.col(f"low{k}") + (F.col(f"high{k}") - F.col(f"low{k}")) * (i + 0.5) / grid
    points = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct(at(0, i).alias("x"), at(1, j).alias("y")))))
    ring_edges = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(r[i][0].alias("x0"), r[i][1].alias("y0"), r[F.pmod(i + 1, F.size(r))][0].alias("x1"), r[F.pmod(i + 1, F.size(r))][1].alias("y1")))
    edges = F.flatten(F.transform(F.filter("rings", lambda r: F.size(r) > 2), ring_edges))
    own = boxes.withColumn("edges", edges).withColumn("held", F.filter(points, lambda p: F.size(F.filter("edges", lambda e: crosses(p["x"], p["y"], e))) % 2 == 1))
    held = F.when(F.size("held") > 0, F.col("held")).otherwise(F.array(F.struct(F.col("mean0").alias("x"), F.col("mean1").alias("y"))))
    return own.select("area", F.explode(held).alias("p")).select("area", "p.x", "p.y")


def votes(inner: DataFrame, outer: DataFrame, area: str, rings: str, size: float, grid: int = 9) -> DataFrame:
    """area, other, n: how many probe points of each inner area lie in each outer area."""
    return join_areas(probes(inner, area, rings, grid), "x", "y", outer, area, rings, size, "other").groupBy("area", "other").agg(F.count("*").alias("n"))


def match_areas(inner: DataFrame, outer: DataFrame, area: str, rings: str, size: float, grid: int = 9) -> DataFrame:
    """area, other, n: the outer area with most votes of each inner area (ties to the least one); without a vote, the one with the
    vertex nearest to the inner area's mean vertex, with n = 0."""
    best = votes(inner, outer, area, rings, size, grid).groupBy("area").agg(F.min(F.struct((-F.col("n")).alias("order"), "other", "n")).alias("b")).select("area", "b.other", "b.n")
    mean = lambda k: F.aggregate(F.flatten(rings), F.lit(0.0), lambda a, v: a + v[k]) / F.size(F.flatten(rings))
    rest = inner.join(best.select(F.col("area").alias(area)), area, "left_anti").select(F.col(area).alias("area"), mean(0).alias("x"), mean(1).alias("y"))
    near = nearest_area(rest, "area", "x", "y", outer.withColumnRenamed(area, "other"), "other", rings)
    # nearest_area names its answer `area` too, so its columns are taken by place.
    return best.unionByName(near.toDF("area", "other", "distance").select("area", "other", F.lit(0).cast("long").alias("n")))
